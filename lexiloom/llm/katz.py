"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, scores per token.

    P(c|b) = d_r r / (n(b) + 1)    r = n(b c) > 0, n(b): how often b is followed by anything
           = a(b) P(c)             otherwise; a(b) = 1 if b was never seen
    P(c)   = e_r r / (N + 1)       r = n(c) > 0; what is left of 1 is the unknown word's
    a(b)   = (1 - sum of P(c|b)) / (1 - sum of P(c)), both sums over the c seen after b

so P(.|b) sums to 1 for every b. d and e are Katz's discounts of counts up to five, from the counts of counts of pairs and of
words; one count more in each denominator leaves something for unseen words where nothing is discounted. A text's first word
follows a mark, its last token is an end.

Every pair of the training texts is counted. Texts are read in batches of some megabytes; a batch knows its tokens by the numbers of its
distinct pairs, and asks for each pair once, so that a frequent pair is one entry of a batch. Pairs are dealt by their second
word (a word of many tokens to several parts, by the first word), counted there over all batches, and the counts go back to the
batches that asked. Each part also sums what its words add to the backoff weights of their contexts. Weights are looked up, by a shuffled join, for unseen pairs only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import workspace
from lexiloom.llm.textkernel import mix, slices, string_buffers, word_bounds, word_hashes

FOLDS, HELD_OUT = 7, 2
#: Counts up to this are discounted.
K = 5
BATCH_BYTES = 6 << 20
#: Training tokens of a part. A word with more than 1 / SPLIT of these is dealt to a part for each such share of its tokens, so that
#: what one word brings to a part does not grow with the input. Fewer than SPLIT words a part are split.
PART_TOKENS, LEAST_PARTS, SPLIT = 1_500_000, 8, 4
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: The end of a text, and the mark before its first word.
END, START = _U(0xE27D), _U(0x57A7)

# arrays are packed into binary cells
_ASKED = "p int, batch long, at long, c binary, runs binary, b binary, n binary"
_PAIRS = "kind int, batch long, at long, ns binary, cs binary, runs binary, b long, n long, s double, " + ", ".join(f"t{r} long" for r in range(1, K + 2))
_HELD = "kind int, batch long, at long, ids array<long>, sizes binary, tok binary, ns binary, cs binary, runs binary, alpha double"
_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    """Whether a row is left out of training; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def good_turing(n: list[int]) -> np.ndarray:
    """Katz's discounts by count 0 to K (0 has 1), from the numbers ``n[r - 1]`` of things seen r times, r = 1 to K + 1.
    A count whose discount would not lie between 0 and 1, or cannot be computed, keeps its full weight."""
    out = np.ones(K + 1)
    if not n[0]:
        return out
    tail = (K + 1) * n[K] / n[0]
    for r in range(1, K + 1):
        if n[r - 1] and tail != 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
            out[r] = d if 0 < d < 1 else 1.0
    return out


def discounted(count: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return count * np.where(count <= K, discounts[np.minimum(count, K)], 1.0)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and where each text begins (and the last ends)."""
    buf, offs = string_buffers(part.column("text"))
    starts, ends, first = word_bounds(buf, offs)
    words = word_hashes(buf, starts, ends, lower=True)
    offsets = first + np.arange(len(first))
    c = np.full(offsets[-1], END, _U)
    is_word = np.ones(len(c), bool)
    is_word[offsets[1:] - 1] = False
    c[is_word] = words
    return c, offsets


def _words(batches):
    for batch in batches:
        for part in slices(batch, limit=BATCH_BYTES):
            c, _ = _tokens(part)
            w, n = np.unique(c, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's number among them; as ``np.unique``, in half the memory."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    distinct = ranked[new]
    del ranked
    number = np.cumsum(new, dtype=np.uint32)
    number -= np.uint32(1)
    out = np.empty_like(number)
    out[order] = number
    return distinct, out


@dataclass
class Hot:
    """The words that are dealt to several parts, in order, their training counts, and the number of shares of each."""

    words: np.ndarray
    counts: np.ndarray
    shares: np.ndarray

    def of(self, words: np.ndarray, values: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The values of those of ``words`` that are hot, and what ``other`` holds for the rest."""
        if not len(self.words):
            return other
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, values[at], other)


def hot_words(words: list[int], counts: list[int], parts: int) -> Hot:
    """``words`` as signed numbers, with their training counts."""
    w, n = np.array(words, np.int64).view(_U), np.array(counts, np.int64)
    order = np.argsort(w)
    return Hot(w[order], n[order], np.minimum(n[order] // (PART_TOKENS // SPLIT) + 1, parts).astype(_U))


def dealt(c: np.ndarray, b: np.ndarray, parts: int, hot: Hot) -> np.ndarray:
    """The part that counts each pair of second words ``c`` and first words ``b``."""
    share = mix(b) % hot.of(c, hot.shares, np.ones(len(c), _U))
    return (np.where(share > 0, mix(c + share * _ODD), c) % _U(parts)).astype(np.uint32)


@dataclass
class Batch:
    """A batch of texts: ``tok`` numbers its tokens' pairs in the order in which they are asked for, by part, second word, first word."""

    number: int
    part: pa.RecordBatch
    offsets: np.ndarray
    tok: np.ndarray
    p: np.ndarray
    c: np.ndarray
    b: np.ndarray


def _batch(number: int, part: pa.RecordBatch, parts: int, hot: Hot) -> Batch:
    c, offsets = _tokens(part)
    vocabulary, ci = numbered(c)
    del c
    bi = np.empty_like(ci)
    bi[1:] = ci[:-1]
    bi[offsets[:-1]] = len(vocabulary)
    key = ci * _U(len(vocabulary) + 1)
    key += bi
    del ci, bi
    pair, tok = numbered(key)
    del key
    tc, tb = np.divmod(pair, _U(len(vocabulary) + 1))
    del pair
    c, b = vocabulary[tc], np.append(vocabulary, START)[tb]
    del tc, tb
    p = dealt(c, b, parts, hot)
    order = np.argsort(p, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return Batch(number, part, offsets, place[tok], p[order], c[order], b[order])


def _numbered(batches, parts: int, hot: Hot):
    """The same batches whenever the same rows are read. None is kept here while the next is made."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, limit=BATCH_BYTES):
            yield _batch(number, part, parts, hot)
            number += 1


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs, after a byte that says how many."""
    width = np.min_scalar_type(int(values.max()) if len(values) else 0).itemsize
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(cell: bytes | pa.Buffer) -> np.ndarray:
    """The numbers of a cell, which stay where they are."""
    return np.frombuffer(cell, f"<u{memoryview(cell)[0]}", offset=1)


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.array([pack(values[i:j]) for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())


def _asked(x: Batch, parts: int) -> pa.RecordBatch:
    """A row for each part: the second words, how many pairs each has, the first words, and training counts."""
    counts = np.repeat(~x.part.column("held").to_numpy(zero_copy_only=False), np.diff(x.offsets))
    n = np.bincount(x.tok[counts], minlength=len(x.c))
    first = np.flatnonzero(np.diff(x.p, prepend=parts + 1))
    run = np.flatnonzero((np.diff(x.p, prepend=parts + 1) != 0) | (x.c != np.append(x.c[:1] + _U(1), x.c[:-1])))
    cuts, run_cuts = np.append(first, len(x.c)), np.append(np.searchsorted(run, first), len(run))
    columns = [pa.array(x.p[first].astype(np.int32)), pa.array(np.full(len(first), x.number)), pa.array(first)]
    columns += [_packed(x.c[run], run_cuts), _packed(np.diff(np.append(run, len(x.c))), run_cuts), _packed(x.b, cuts), _packed(n, cuts)]
    return pa.RecordBatch.from_arrays(columns, names=["p", "batch", "at", "c", "runs", "b", "n"])


def _held(x: Batch) -> pa.RecordBatch:
    """A row: the texts' ids and sizes, and the tokens by number."""
    ids = x.part.column("doc_id")
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([pa.array([x.number]), pa.array([len(x.c)]), ids, pa.array([pack(np.diff(x.offsets))]), pa.array([pack(x.tok)])], names=["batch", "at", "ids", "sizes", "tok"])


def _ask(parts: int, hot: Hot):
    return lambda batches: map(lambda x: _asked(x, parts), _numbered(batches, parts, hot))


def _hold(parts: int, hot: Hot):
    return lambda batches: map(_held, _numbered(batches, parts, hot))


def _cells(table: pa.Table, name: str) -> list[np.ndarray]:
    return [unpack(x.as_buffer()) for x in table[name]]


def _flat(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    """The numbers of all rows' cells, one after the other."""
    return np.concatenate([np.zeros(0, kind), *_cells(table, name)], dtype=kind, casting="unsafe")


def _cuts(table: pa.Table, name: str) -> np.ndarray:
    """Where each row's cell begins in ``_flat``, and where the last ends."""
    return np.append(0, np.cumsum([len(x) for x in _cells(table, name)]))


def _rows(schema: str, size: int, **columns) -> pa.Table:
    """A table of ``schema`` with nulls in the columns not given."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({name: columns[name].cast(kinds[kind]) if name in columns else pa.nulls(size, kinds[kind]) for name, kind in fields})


def _count(words: np.ndarray, hot: Hot):
    """One part: counts for all who asked (kind 1), the unseen pairs (kind 2), and sums of contexts (kind 3)."""

    def run(table: pa.Table) -> pa.Table:
        cuts = _cuts(table, "b")
        of_c, c_at = numbered(_flat(table, "c", _U))
        of_b, b_at = numbered(_flat(table, "b", _U))
        second = np.repeat(c_at, _flat(table, "runs"))
        key = second * _U(len(of_b))
        key += b_at
        pair, at = numbered(key)
        del key
        n = _flat(table, "n", float)
        seen = np.bincount(at, weights=n, minlength=len(pair)).astype(np.int64)
        word = hot.of(of_c, hot.counts, np.bincount(second, weights=n, minlength=len(of_c)).astype(np.int64))
        del n, second
        found = seen[at]
        del at
        answers = _rows(_PAIRS, table.num_rows, kind=pa.array(np.ones(table.num_rows, np.int32)), batch=table["batch"], at=table["at"], ns=_packed(found, cuts), cs=_packed(word[c_at], _cuts(table, "c")), runs=table["runs"])

        none = np.flatnonzero(found == 0)
        del found
        row = np.searchsorted(cuts, none, side="right") - 1
        unseen = _rows(_PAIRS, len(none), kind=pa.array(np.full(len(none), 2)), batch=table["batch"].take(pa.array(row)), at=pa.array(table["at"].to_numpy()[row] + none - cuts[row]), b=pa.array(of_b[b_at[none]].view(np.int64)))
        del b_at, none, row
        return pa.concat_tables([answers, unseen, _contexts(of_b, pair, seen, discounted(word, words))])

    return run


def _contexts(of_b: np.ndarray, pair: np.ndarray, seen: np.ndarray, word: np.ndarray) -> pa.Table:
    """Sums over the seen pairs of each first word; ``pair`` numbers second words, whose discounted counts are ``word``, and first words."""
    second, first = np.divmod(pair[seen > 0], _U(len(of_b)))
    r, of, p = seen[seen > 0], first.astype(np.int64), word[second]
    del second, first
    total = lambda w: np.bincount(of, weights=w, minlength=len(of_b))
    n_b = total(r)
    held = n_b > 0
    classes = {f"t{k}": pa.array(total(r == k)[held].astype(np.int64)) for k in range(1, K + 2)}
    return _rows(_PAIRS, int(held.sum()), kind=pa.array(np.full(int(held.sum()), 3)), b=pa.array(of_b[held].view(np.int64)), n=pa.array(n_b[held].astype(np.int64)), s=pa.array(total(p)[held]), **classes)


@dataclass
class Model:
    """Training tokens and distinct words, training texts, and the discounts of words and pairs."""

    tokens: int
    distinct: int
    texts: int
    words: np.ndarray
    pairs: np.ndarray

    @property
    def unknown(self) -> float:
        return 1.0 - self.known / (self.tokens + 1)

    known: float = 0.0


def log_probability(model: Model, pair: np.ndarray, word: np.ndarray, context: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """log10 P of each token, from the counts of its pair, its word and its context, and the backoff weight of the context:
    the pair's own discounted count, or else the weight times the word's, or else times the unknown word's share."""
    by_pair = discounted(pair, model.pairs) / (context + 1.0)
    by_word = np.where(word > 0, discounted(word, model.words) / (model.tokens + 1.0), model.unknown)
    return np.log10(np.where(pair > 0, by_pair, alpha * by_word))


def _score(model: Model):
    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        of = lambda k: table.filter(pa.array(kind == k)).sort_by("at")
        batch, answers, weights = of(0), of(1), of(2)
        sizes, tok = _flat(batch, "sizes"), _flat(batch, "tok")
        pair, word = _flat(answers, "ns"), np.repeat(_flat(answers, "cs"), _flat(answers, "runs"))
        if len(pair) != batch["at"][0].as_py():
            raise ValueError("a batch was not read as before; scoring needs an input that gives the same rows in the same order")
        alpha = np.ones(len(pair))
        alpha[weights["at"].to_numpy()] = weights["alpha"].to_numpy()
        first = np.cumsum(sizes) - sizes
        word = word[tok]
        context = np.append(model.texts, word[:-1])
        context[first] = model.texts
        logs = log_probability(model, pair[tok], word, context, alpha[tok])
        base = np.log10((word + 1.0) / (model.tokens + model.distinct + 1))
        total = lambda x: pa.array(np.add.reduceat(x, first))
        return pa.table({"doc_id": batch["ids"].combine_chunks().flatten(), "n_tokens": pa.array(sizes), "n_known": total((word > 0).astype(np.int64)), "base_score": total(base), "score": total(logs)})

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs(doc_id, text, ...)``.

    Null texts are empty: one token, the end. Rows with a null doc_id are training rows. Repeated rows count as often as they are there; without
    any training row every token is unknown, with probability 1. An empty table gives no rows; other columns are
    ignored. Words are told apart by 64-bit hashes. ``docs`` is read three times and must give the same rows in the same order
    (a table does); otherwise scoring stops with an error.
    """
    workspace.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held", held_out(F.col("doc_id")))

    unigrams = rows.filter(~F.col("held")).select("text").mapInArrow(_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    unigrams = workspace.materialize(unigrams, "unigrams")
    of_counts = lambda c: [F.count_if(F.col(c) == r) for r in range(1, K + 2)]
    facts = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("w") == int(END), F.col("n"))), F.lit(0)), *of_counts("n")).first()
    tokens, distinct, texts, *counts = [int(x) for x in facts]
    words = good_turing(counts)
    known = tokens - sum(r * n * (1 - words[r]) for r, n in zip(range(1, K + 1), counts))
    parts = max(LEAST_PARTS, -(-tokens // PART_TOKENS))
    frequent = unigrams.filter(F.col("n") * SPLIT > PART_TOKENS).select("w", "n").collect()  # fewer than SPLIT rows a part
    hot = hot_words([r["w"] for r in frequent], [r["n"] for r in frequent], parts)

    asked = rows.select("text", "held").mapInArrow(_ask(parts, hot), _ASKED)
    pairs = workspace.materialize(asked.groupBy("p").applyInArrow(_count(words, hot), _PAIRS), "pairs")
    sums = [F.sum(c).alias(c) for c in ("n", "s", *(f"t{r}" for r in range(1, K + 2)))]
    contexts = workspace.materialize(pairs.filter("kind = 3").groupBy("b").agg(*sums), "contexts")
    totals = contexts.agg(*[F.coalesce(F.sum(f"t{r}"), F.lit(0)) for r in range(1, K + 2)]).first()
    model = Model(tokens, distinct, texts, words, good_turing([int(t) for t in totals]), known)

    lost = sum((F.col(f"t{r}") * float(r * (1 - model.pairs[r])) for r in range(1, K + 1)), F.lit(0.0))
    alpha = ((lost + 1) / (F.col("n") + 1)) / (1 - F.col("s") / float(tokens + 1))
    unseen = pairs.filter("kind = 2").select("batch", "at", "b").join(contexts.select("b", alpha.alias("alpha")), "b", "left")
    batches = rows.select("doc_id", "text").mapInArrow(_hold(parts, hot), "batch long, at long, ids array<long>, sizes binary, tok binary")

    names = [f.split(" ")[0] for f in _HELD.split(", ")]
    fit = lambda df, kind: df.withColumn("kind", F.lit(kind)).select(*[c if c in (*df.columns, "kind") else F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in _HELD.split(", "))])
    answers = fit(pairs.filter("kind = 1").select("batch", "at", "ns", "cs", "runs"), 1)
    weights = fit(unseen.select("batch", "at", F.coalesce("alpha", F.lit(1.0)).alias("alpha")), 2)
    scored = fit(batches, 0).unionByName(answers).unionByName(weights).select(*names).groupBy("batch").applyInArrow(_score(model), _SCORES)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
