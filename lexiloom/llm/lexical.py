"""Ranked lexical search: WAND over shards of documents.

Each task turns its documents into postings of the query terms. Counts over all documents (how many there are, their terms, and
the documents of each query term) fix the impact of every posting. A shard holds its postings by term, in order of
documents, with the largest impact of each term. For an item, the terms' cursors are ordered by the document they stand at; the
pivot is the first document at which the largest impacts of the terms up to there can reach the worst score of the item's heap. Nothing
before the pivot is looked at. From the pivot on a window of documents is judged: those whose terms' largest impacts cannot
reach the heap are skipped, the others are scored. Heaps of shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import workspace
from lexiloom.llm.textkernel import slices, string_buffers, word_bounds, word_hashes

TOP = 10
#: Items of a block: their terms, and heaps of ten, are what a task holds. Blocks follow one another, so any number of items is answered.
BLOCK_ITEMS = 2048
#: Postings of a shard.
SHARD_POSTINGS = 2_000_000
#: Documents that are judged from a pivot on before the next pivot is chosen.
WINDOW = 512
_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms (A-Z lower-cased), and the index of each text's first."""
    buf, offs = string_buffers(column)
    starts, ends, first = word_bounds(buf, offs, _BREAK)
    return word_hashes(buf, starts, ends, lower=True), first


def query_terms(items: list[tuple[int | None, str | None]]) -> tuple[list[int | None], np.ndarray, list[np.ndarray]]:
    """Distinct item ids, the sorted distinct terms of all, and each item's places among these. Rows of one id are one item."""
    hashes, first = text_terms(pa.array([t for _, t in items], pa.string()))
    own: dict[int | None, list[np.ndarray]] = {}
    for i, (item, _) in enumerate(items):
        own.setdefault(item, []).append(hashes[first[i] : first[i + 1]])
    terms = np.unique(hashes)
    return list(own), terms, [np.searchsorted(terms, np.unique(np.concatenate(h))) for h in own.values()]


def _postings(terms: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, first = text_terms(part.column("text"))
                n = np.diff(first)
                doc = np.repeat(np.arange(part.num_rows), n)
                at = np.searchsorted(terms, hashes)
                at[at == len(terms)] = 0
                hit = terms[at] == hashes if len(terms) else np.zeros(len(at), bool)
                key, tf = np.unique(doc[hit] * max(1, len(terms)) + at[hit], return_counts=True)
                d, t = np.divmod(key, max(1, len(terms)))
                offsets = pa.array(np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (t, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


class Heap:
    """The best ten (score, doc_id), equal scores by smaller doc_id; null ids last."""

    def __init__(self, top: int):
        self.top, self.score = top, np.zeros(0, np.int64)
        self.ids: list[int | None] = []

    @property
    def least(self) -> int:
        """A document needs this score to get in, or to tie."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def push(self, score: np.ndarray, ids: list[int | None]) -> None:
        rows = sorted(zip(self.score.tolist() + score.tolist(), self.ids + ids), key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.top]
        self.score, self.ids = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]


class Shard:
    """Postings of some documents by term: documents in order, impacts, and each term's largest impact."""

    def __init__(self, ids: list[int | None], m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order].astype(np.int64)
        self.ids, self.doc = ids, doc
        self.impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        self.first = np.searchsorted(term, np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact, self.first[some])

    def search(self, terms: np.ndarray, heap: Heap, window: int = WINDOW) -> int:
        """WAND for one item; returns how many documents were scored."""
        terms = terms[self.most[terms] > 0]
        if not len(terms):
            return 0
        at, end, most, scored = self.first[terms].copy(), self.first[terms + 1], self.most[terms], 0
        while True:
            live = at < end
            if not live.all():
                at, end, most = at[live], end[live], most[live]
                if not len(at):
                    return scored
            stand = self.doc[at]
            order = np.argsort(stand, kind="stable")
            k = int(np.searchsorted(np.cumsum(most[order]), heap.least))
            if k == len(order):
                return scored
            pivot = int(stand[order[k]])
            for j in order[:k]:
                at[j] += np.searchsorted(self.doc[at[j] : end[j]], pivot)
            to = np.array([a + np.searchsorted(self.doc[a:e], pivot + window) for a, e in zip(at, end)])
            place = np.concatenate([np.arange(a, t) for a, t in zip(at, to)])
            doc = self.doc[place] - pivot
            can = np.zeros(window, np.int64)
            np.add.at(can, doc, np.repeat(most, to - at))
            chosen = can >= heap.least
            keep = chosen[doc]
            score = np.zeros(window, np.int64)
            np.add.at(score, doc[keep], self.impact[place[keep]])
            scored += int(chosen.sum())
            best = np.flatnonzero(score >= heap.least)
            if len(best):
                heap.push(score[best], [self.ids[pivot + b] for b in best])
            at = to


def _shards(batches, weight: np.ndarray, n_docs: int, n_terms: int, limit: int):
    """Shards of about ``limit`` postings; documents by id, so that a later one loses a tie."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            held.append(part)
            size += len(part.column("terms").flatten())
            if size >= limit:
                yield _shard(held, weight, n_docs, n_terms)
                held, size = [], 0
    if size:
        yield _shard(held, weight, n_docs, n_terms)


def _shard(held: list[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_terms: int) -> Shard:
    table = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()
    terms = table["terms"].combine_chunks()
    counts = pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    m = 10 + (90 * table["n"].to_numpy() * n_docs) // n_terms
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (terms, table["tfs"].combine_chunks())]
    return Shard(table["doc_id"].to_pylist(), m, np.repeat(np.arange(len(counts)), counts), flat[0], flat[1], weight)


def _search_block(rows: DataFrame, items: list[tuple[int | None, str | None]], top: int) -> DataFrame:
    """item_id, doc_id, score: for each item the best ten of each task."""
    ids, terms, wanted = query_terms(items)
    postings = workspace.materialize(rows.mapInArrow(_postings(terms), "doc_id long, n long, terms array<int>, tfs array<int>"), "postings")
    total = postings.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = int(total["docs"]), int(total["terms"])
    df = np.zeros(len(terms), np.int64)
    for term, n in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block's items
        df[term] = n
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def best(batches):
        heaps = [Heap(top) for _ in ids]
        for shard in _shards(batches, weight, n_docs, n_terms, SHARD_POSTINGS):
            for heap, own in zip(heaps, wanted):
                shard.search(own, heap)
        out = [(i, d, s) for i, h in zip(ids, heaps) for s, d in zip(h.score.tolist(), h.ids)]
        columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return postings.filter(F.size("terms") > 0).mapInArrow(best, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each item of ``items(item_id, text, ...)`` the ``top`` rows of ``docs(doc_id, text, ...)`` with the highest score above 0.

    Null and empty texts hold no terms: such documents are found by no item and do not count, such items find nothing. Rows of one
    item_id (null too) are one item with the terms of all; rows of one doc_id are documents of their own. Equal scores are in order of
    doc_id, null last. An empty table on either side gives no rows; other columns are ignored. Terms are told apart by 64-bit hashes.
    """
    workspace.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-asked.select("item_id").distinct().count() // BLOCK_ITEMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        block = [(r["item_id"], r["text"]) for r in asked.filter(F.col("block") == b).select("item_id", "text").collect()]
        part = _search_block(rows, block, top)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
