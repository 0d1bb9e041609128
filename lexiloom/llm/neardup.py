"""Near-duplicate classes by circulant MinHash.

One permutation (``sigma``, a hash) scatters shingles over D positions; the other (``pi``, a seeded
table) is used K times, each time shifted by one position. The K shifted values of a shingle
are neighbours in the table, so a signature is a running minimum over table rows.
Bands propose candidates; every link is confirmed on full shingle sets.

The work per group of copies stays linear: texts with equal sets form a class first; in each bucket
all classes meet one leader (the class met in most buckets); confirmed links are merged. Bucket members
that still lie in different components, and that have a partner within bounds on set sizes and on
a 256-bit sketch of the signature, are compared on their full sets in blocks of bounded size; a block
reports one link at most from a class to each other component, never pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import workspace
from lexiloom.llm.components import connected_components
from lexiloom.llm.textkernel import mix, shingle_set, slices, string_buffers, word_bounds, word_hashes

COORDINATES = 256  # shifts of pi; all feed the sketch
BANDS, ROWS = 32, 4  # of the first 128 coordinates: a pair at 0.75 is missed with chance 5e-6
POSITIONS_LOG2 = 20
#: Sketch bits that may differ: 32 of 256 are expected at 0.75, 56 lie 4.5 deviations above.
SKETCH_BITS = 56
#: Shingles on either side of a block of comparisons.
BLOCK_SHINGLES = 500_000
#: Members of a bucket on either side that meet in one task.
MEET = 1024
#: Buckets of several blocks up to which their plan is sent to all executors.
BROADCAST_BUCKETS = 100_000
#: Document ids up to which they are sent to all executors to pick texts; beyond, texts are shuffled by id.
BROADCAST_IDS = 1_000_000
_SIG = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"
_U = np.uint64


@lru_cache(maxsize=2)
def _shifted(seed: int) -> np.ndarray:
    """Row s holds pi at positions s, s+1, ..., s+K-1 of the circle."""
    d = 1 << POSITIONS_LOG2
    pi = np.random.default_rng(seed).permutation(d).astype(np.uint32) * np.uint32(1 << (32 - POSITIONS_LOG2))
    return sliding_window_view(np.concatenate([pi, pi[:COORDINATES]]), COORDINATES)


def signature(shingles: np.ndarray, seed: int = 7) -> np.ndarray:
    """The K coordinates of a non-empty shingle set."""
    table = _shifted(seed)
    at = (mix(shingles + _U(seed)) >> _U(64 - POSITIONS_LOG2)).astype(np.int64)
    out = table[at[:1024]].min(axis=0)
    for i in range(1024, len(at), 1024):
        np.minimum(out, table[at[i : i + 1024]].min(axis=0), out=out)
    return out


def _text_sets(part: pa.RecordBatch):
    buf, offs = string_buffers(part.column("text"))
    starts, ends, first = word_bounds(buf, offs)
    words = word_hashes(buf, starts, ends, lower=True)
    for i in range(part.num_rows):
        yield shingle_set(words[first[i] : first[i + 1]])


def _signatures(batches):
    salts = mix(np.arange(1, BANDS + 1, dtype=_U))
    for batch in batches:
        for part in slices(batch):
            n, h1, h2, bands, sketches = [], [], [], [], []
            for s in _text_sets(part):
                n.append(len(s))
                h1.append(int(mix(s + _U(11)).sum(dtype=_U).view(np.int64)) if len(s) else 0)
                h2.append(int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)) if len(s) else 0)
                if not len(s):
                    bands.append([])
                    sketches.append([])
                    continue
                sig = signature(s)
                key = salts.copy()
                for k in range(ROWS):
                    key = mix(key ^ sig[: BANDS * ROWS].reshape(BANDS, ROWS)[:, k].astype(_U))
                bands.append(key.view(np.int64))
                bits = (mix(sig.astype(_U) + (np.arange(COORDINATES, dtype=_U) << _U(32))) & _U(1)).astype(np.uint8)
                sketches.append(np.packbits(bits).view(np.int64))
            ids = part.column("doc_id")
            longs = lambda x: pa.array(x, pa.int64())
            lists = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, longs(n), longs(h1), longs(h2), lists(bands), lists(sketches)], names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])


def _full_sets(batches):
    for batch in batches:
        for part in slices(batch):
            sets = pa.array([s.view(np.int64) for s in _text_sets(part)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets], names=["id", "shingles"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: set size, a 128-bit identity of the set, band keys and sketch (empty for no words)."""
    workspace.ship(docs.sparkSession)
    return _rows(docs).mapInArrow(_signatures, _SIG)


def _close(sa: str, sb: str, na: str, nb: str, threshold: int):
    differ = sum((F.bit_count(F.get(sa, F.lit(i)).bitwiseXOR(F.get(sb, F.lit(i)))) for i in range(4)), F.lit(0))
    sizes = (100 * F.least(na, nb)) >= (threshold * F.greatest(na, nb))
    return sizes & (differ <= SKETCH_BITS)


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id and shingles of the documents in ids(doc_id)."""
    ids, seen = workspace.observed(ids.distinct(), "ids", F.count(F.lit(1)).alias("n"))
    few = seen["n"] <= BROADCAST_IDS
    texts = _rows(docs).filter("doc_id is not null").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return workspace.materialize(texts.mapInArrow(_full_sets, "id long, shingles array<long>"), "sets")


def _confirm(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Of pairs(a, b), those whose full sets are similar enough."""
    sets = _sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))), docs)
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    similar = (100 * both) >= threshold * (F.size("sa") + F.size("sb") - both)
    out = workspace.materialize(pairs.join(a, "a").join(b, "b").filter(similar).select("a", "b").distinct(), "links")
    workspace.drop(sets)
    return out


def block_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], threshold: int) -> set[tuple[int, int]]:
    """Pairs of components with a link between a left and a right (component, shingles) member."""
    shingles = np.concatenate([s for _, s in right])
    owner = np.repeat(np.arange(len(right)), [len(s) for _, s in right])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    size = np.array([len(s) for _, s in right])
    comp = np.array([c for c, _ in right])
    out: set[tuple[int, int]] = set()
    for c, s in left:
        lo, hi = np.searchsorted(shingles, s, "left"), np.searchsorted(shingles, s, "right")
        hit = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
        both = np.bincount(owner[hit], minlength=len(right))
        near = (100 * both >= threshold * (len(s) + size - both)) & (comp != c)
        out |= {(c, int(x)) for x in np.unique(comp[near])}
    return out


def _dealt(rows: DataFrame, plan: DataFrame, side: int) -> DataFrame:
    """rows(key, rep, ...) in the blocks (i, j) of their bucket, by plan(key, n0, n1) of the buckets with several: a row of side 0 is in one
    i and every j, one of side 1 in one j and every i."""
    plan, seen = workspace.observed(plan, "plan", F.count(F.lit(1)).alias("n"))
    few = seen["n"] <= BROADCAST_BUCKETS
    rows = rows.join(F.broadcast(plan) if few else plan, "key", "left").fillna(1, ["n0", "n1"])
    own = F.pmod(F.xxhash64("rep"), F.col(f"n{side}")).cast("int")
    every = F.explode(F.sequence(F.lit(0), (F.col(f"n{1 - side}") - 1).cast("int")))
    return rows.withColumn("i", own if side == 0 else every).withColumn("j", every if side == 0 else own).drop("n0", "n1")


def _cross_links(open_: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Links(a, b) between components that meet in a bucket: rows of open_ are bucket members."""
    apart = F.col("comp") != F.col("main")
    pieces = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    several = F.col("n0") * F.col("n1") > 1
    plan = open_.groupBy("key").agg(pieces(F.count_if(apart), MEET).alias("n0"), pieces(F.count(F.lit(1)), MEET).alias("n1")).filter(several)
    a, b = _dealt(open_.filter(apart), plan, 0), _dealt(open_, plan, 1)
    other = lambda df: df.select(*[F.col(c).alias(f"o{c}") for c in ("key", "i", "j", "comp", "n", "sketch")])
    same = (F.col("key") == F.col("okey")) & (F.col("i") == F.col("oi")) & (F.col("j") == F.col("oj"))
    met = same & (F.col("comp") != F.col("ocomp")) & _close("sketch", "osketch", "n", "on", threshold)
    columns = ["key", "rep", "comp", "n"]
    left = a.join(other(b), met, "left_semi").select(*columns, F.lit(0).alias("side"))
    right = b.join(other(a), met, "left_semi").select(*columns, F.lit(1).alias("side"))
    active = workspace.materialize(left.unionByName(right).distinct(), "active")
    shingles = lambda side: pieces(F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0)), BLOCK_SHINGLES)
    blocks = lambda side: F.greatest(shingles(side), pieces(F.count_if(F.col("side") == side), MEET))
    plan = active.groupBy("key").agg(blocks(0).alias("n0"), blocks(1).alias("n1")).filter(several)
    dealt = [_dealt(active.filter(F.col("side") == side), plan, side).select("key", "rep", "comp", "side", "i", "j") for side in (0, 1)]
    sets = _sets_of(active.select(F.col("rep").alias("doc_id")), docs)
    rows = dealt[0].unionByName(dealt[1]).join(sets, F.col("rep") == F.col("id")).select("key", "i", "j", "comp", "side", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        side, comp = table.column("side").to_pylist(), table.column("comp").to_pylist()
        lists = table.column("shingles").combine_chunks()
        values, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
        parts = ([], [])
        for r, (s, c) in enumerate(zip(side, comp, strict=True)):
            parts[s].append((c, values[offsets[r] : offsets[r + 1]]))
        links = sorted(block_links(*parts, threshold)) if all(parts) else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text, ...)``.

    Documents link when 100 * |A & B| >= threshold * |A | B| over distinct 5-word shingles of the
    text with A-Z lowered. component_id is the smallest doc_id reachable over links.
    Null or wordless texts have an empty set and link with nothing; texts of fewer than five words
    are one shingle. Rows with one doc_id are one document: all have the component of its rows' links.
    A null doc_id links with nothing, has a null component_id and is kept. Other columns are ignored.
    """
    sig = workspace.materialize(signatures(docs), "signatures")
    usable = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = workspace.materialize(classes.select("h1", "h2", "copies", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), "r.bands", "r.sketch"), "classes")

    rows = reps.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    members = workspace.materialize(rows.join(shared, "key"), "members")
    facts = reps.select("rep", "n", "sketch")
    degree = members.groupBy("rep").agg(F.sum("c").alias("degree"))
    ranked = members.join(degree, "rep")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("m"))).alias("x")).select("key", (-F.col("x.m")).alias("lead"))
    stars = ranked.join(leaders, "key").filter("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    fa = facts.toDF("a", "na", "ka")
    fb = facts.toDF("b", "nb", "kb")
    stars = workspace.materialize(stars.join(fa, "a").join(fb, "b").filter(_close("ka", "kb", "na", "nb", threshold)).select("a", "b").distinct(), "stars")
    links = _confirm(stars, docs, threshold)
    workspace.drop(stars)
    # rows that share a doc_id but not a text: their classes belong together
    sets = sig.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi"))
    several = workspace.materialize(sets.filter("lo != hi").select("doc_id"), "several")
    own = usable.join(several, "doc_id").select("doc_id", "h1", "h2").distinct().join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep")
    own = workspace.materialize(own, "own")
    links = links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).filter("a != b"))
    first = workspace.materialize(connected_components(links), "components")

    at = members.join(first.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    by_comp = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    open_ = by_comp.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("x"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("key", F.col("x.comp").alias("main"))
    left = workspace.materialize(at.join(open_, "key").join(facts, "rep").select("key", "rep", "comp", "main", "n", "sketch"), "open")
    workspace.drop(members)
    second = connected_components(_cross_links(left, docs, threshold))
    workspace.drop(left)

    label = reps.select("h1", "h2", "copies", "rep").join(first.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    label = label.join(second.toDF("comp", "root"), "comp", "left").select("h1", "h2", "rep", "copies", F.coalesce("root", "comp").alias("root"))
    by_class = label.filter("copies > 1 or root != rep").select("h1", "h2", "root")
    by_doc = own.join(label.select("rep", "root"), "rep").groupBy("doc_id").agg(F.min("root").alias("doc_root"))
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(by_class, ["h1", "h2"], "left").join(by_doc, "doc_id", "left")
    own_root = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    component = F.coalesce("doc_root", own_root)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
