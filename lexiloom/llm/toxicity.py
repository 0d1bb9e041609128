"""Toxicity by class-conditional Kneser-Ney bigram models.

A class's probability of a word after another is its discounted bigram count, and what the discount takes is given back
through a lower order: the counts that both classes share, tilted towards the words that the class prefers.

    P_c(w|v) = [n_c(v w) - D]+ / n_c(v) + g_c(v) S(w|v) r_c(w) / Z_c(v)      g_c(v): the discounted share of v's counts
    S(w|v)   = [n(v w) - D0]+ / n(v) + g(v) S(w)                             counts of both classes together
    S(w)     = [L(w) - D0]+ / L + (discounted share of L) / (V + 1)          L: distinct left neighbours; one place is unknown
    r_c(w)   = P_c(w) / S(w),  P_c(w) = [L_c(w) - D]+ / L_c + (discounted share of L_c) S(w)
    Z_c(v)   = sum of S(w|v) r_c(w) over w

so each P_c(.|v) sums to 1 over the vocabulary and the unknown word. A pair counts once per text (one text cannot make it
common), and every text's first word follows a mark. All pairs of all labelled rows enter the counts: a pair seen
once is in the sums of its two words, which are kept for every word, so only pairs seen again need rows of their own. A pair that
neither class has over D times has the ratio of its words, by the formula itself; the same holds for words and contexts.
A text is judged by its length-normalised log-likelihood ratio, over the whole and over its worst short and long
stretch, through a logistic fit on rows that were not counted.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import workspace
from lexiloom.llm.textkernel import slices, string_buffers, word_bounds, word_hashes

FOLDS = 5  # fold 0 is held out, the last calibrates, the others are counted
#: Entries that executors hold in memory, at 16 bytes each; the model itself has no such bound.
HEAD_WORDS, HEAD_PAIRS = 1_000_000, 2_000_000
CALIBRATION_ROWS = 5000
STRETCHES = (1, 6, 30)
#: Labels up to which they are sent to all executors to pick texts; beyond, texts are shuffled by id.
BROADCAST_LABELS = 1_000_000
#: Discounts of a class's own counts and of the shared ones.
D, D0 = 2, 1
#: The mark before a text's first word.
START = 0x5EED
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), ord("_")]] = False


def fold(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (runs of letters, digits, _ and non-ASCII; lower case) and the index of each text's first."""
    buf, offs = string_buffers(pa.compute.utf8_lower(part.column("text").cast(pa.large_string())))
    starts, ends, first = word_bounds(buf, offs, _BREAK)
    return word_hashes(buf, starts, ends, lower=False), first


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first * _ODD + second


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where they are not in it."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _before(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word; the mark before the first of each text."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[first[first < len(words)]] = START
    return out


@dataclass
class Table:
    """Log ratios by sorted keys."""

    keys: np.ndarray
    ratio: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, ratio: np.ndarray) -> Table:
        order = np.argsort(keys)
        return Table(keys[order], ratio[order])

    def look(self, keys: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
        """Ratios, and whether each key is in the table."""
        at = _find(self.keys, keys)
        out = np.full(len(keys), other)
        out[at >= 0] = self.ratio[at[at >= 0]]
        return out, at >= 0


@dataclass
class Head:
    """Ratios that executors hold: of words, of contexts, and of pairs, which speak over both."""

    words: Table
    contexts: Table
    pairs: Table
    unknown: float

    def look(self, words: np.ndarray, first: np.ndarray):
        """Per place: the ratios of word, context and pair, and whether each is held."""
        v = _before(words, first)
        return self.words.look(words, self.unknown), self.contexts.look(v, 0.0), self.pairs.look(_pair_keys(v, words), 0.0)


def _place_ratios(word, context, pair) -> np.ndarray:
    return np.where(pair[1], pair[0], word[0] + context[0])


@dataclass
class Model:
    """``tails`` hold what the head does not: (k, ratio) of words and of contexts, (v, w, ratio) of pairs; None if the head holds all."""

    head: Head
    tails: tuple[DataFrame, DataFrame, DataFrame] | None
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def score(self, x: Column) -> Column:
        z = F.lit(float(self.weights[0]))
        for i, (w, c, s) in enumerate(zip(self.weights[1:], self.centre, self.spread)):
            z = z + (x[i] - float(c)) / float(s) * float(w)
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _stretches(ratios: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    total = np.concatenate([[0.0], np.cumsum(ratios)])
    out = np.zeros((len(first) - 1, 1 + len(STRETCHES)))
    for i in range(len(out)):
        t = total[first[i] : first[i + 1] + 1]
        n = len(t) - 1
        if n:
            out[i, 0] = (t[-1] - t[0]) / n
            for k, width in enumerate(STRETCHES):
                w = min(width, n)
                out[i, 1 + k] = (t[w:] - t[:-w]).max() / width
    return list(out)


def _measure(head: Head, names: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words, first = _words(part)
                parts = head.look(words, first[:-1])
                if "hits" in part.schema.names:
                    for i, hits in enumerate(part.column("hits").to_pylist()):
                        for hit in hits or []:
                            ratio, held = parts[hit["kind"]]
                            ratio[first[i] + hit["pos"]], held[first[i] + hit["pos"]] = hit["ratio"], True
                x = _stretches(_place_ratios(*parts), first)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    return run


def with_features(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(..., text)`` without text, with the features ``x`` of the text."""
    head, others = model.head, [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in others]
    if model.tails is None:
        return rows.mapInArrow(_measure(head, names), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "x array<double>"]))

    def beyond(batches):
        for batch in batches:
            for part in slices(batch):
                words, first = _words(part)
                before, held = _before(words, first[:-1]), [h for _, h in head.look(words, first[:-1])]
                at = np.flatnonzero(~held[2])
                text = np.searchsorted(first, at, side="right") - 1
                out = [part.column(n).take(pa.array(text)) for n in ("k1", "k2")]
                out += [pa.array(at - first[text]), pa.array(~held[0][at]), pa.array(~held[1][at]), pa.array(before.view(np.int64)[at]), pa.array(words.view(np.int64)[at])]
                yield pa.RecordBatch.from_arrays(out, names=["k1", "k2", "pos", "new_word", "new_context", "v", "w"])

    # equal texts have equal features: each text is measured once, under 96 bits of hashes
    key = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"), F.hash(F.coalesce("text", F.lit(""))).alias("k2")]
    texts = workspace.materialize(rows.select(*key, "text").groupBy("k1", "k2").agg(F.min("text").alias("text")), "texts")
    misses = workspace.materialize(texts.mapInArrow(beyond, "k1 long, k2 int, pos long, new_word boolean, new_context boolean, v long, w long"), "misses")
    words, contexts, pairs = model.tails
    hit = lambda kind: ("k1", "k2", "pos", F.lit(kind).alias("kind"), "ratio")
    found = misses.join(pairs, ["v", "w"]).select(*hit(2))
    found = found.unionByName(misses.filter("new_word").join(words, F.col("w") == F.col("k")).select(*hit(0)))
    found = found.unionByName(misses.filter("new_context").join(contexts, F.col("v") == F.col("k")).select(*hit(1)))
    found = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "kind", "ratio")).alias("hits"))
    measures = texts.join(found, ["k1", "k2"], "left").select("k1", "k2", "text", "hits").mapInArrow(_measure(head, ["k1", "k2"]), "k1 long, k2 int, x array<double>")
    return rows.select(*names, *key).join(measures, ["k1", "k2"]).select(*names, "x")


def _once(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the first of each key in each text."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(k), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return order[new]


def _sums(key: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of key, and how often each class has them."""
    order = np.lexsort(key.T)
    key, toxic = key[order], toxic[order].astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(key)))
    t = np.add.reduceat(toxic, at) if len(at) else np.zeros(0, np.int64)
    return key[at].view(np.int64), t, n - t


#: Kinds of counts: a pair (v, w); a word as the second of pairs, and as the first.
PAIR, SECOND, FIRST = 0, 1, 2


def _count(batches):
    """Texts of each class with a pair, and the sums of these over the pairs of a word."""
    for batch in batches:
        for part in slices(batch):
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)
            words, first = _words(part)
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            before = _before(words, first[:-1])
            once = _once(doc, _pair_keys(before, words))
            v, w, mark = before[once], words[once], toxic[doc[once]]
            zero = np.zeros(len(once), _U)
            for kind, key in ((PAIR, (v, w)), (SECOND, (zero, w)), (FIRST, (v, zero))):
                k, t, o = _sums(np.stack(key, axis=1), mark)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), *(pa.array(np.ascontiguousarray(k[:, i])) for i in (0, 1)), pa.array(t), pa.array(o)], names=["kind", "v", "w", "t", "o"])


def kneser_ney(counted: DataFrame) -> tuple[tuple[DataFrame, DataFrame, DataFrame], float, bool]:
    """From ``counted(text, toxic)``: ratio tables of words and contexts (k, n, ratio) and of pairs (v, w, n, ratio), the ratio
    of a word that is in no table, and whether both classes were seen (if not, all ratios are 0). A context in no table has
    ratio 0, a pair in no table the sum of its word's and its context's ratios."""
    counts = counted.mapInArrow(_count, "kind byte, v long, w long, t long, o long").groupBy("kind", "v", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    counts = workspace.materialize(counts.filter((F.col("kind") != PAIR) | (F.col("t") + F.col("o") > 1)), "counts")
    more = lambda c, d: F.greatest(c - d, F.lit(0))
    t, o, n = F.col("t"), F.col("o"), F.col("t") + F.col("o")
    again = counts.filter(F.col("kind") == PAIR).select("v", "w", "t", "o")
    columns = ["st", "so", "ft", "fo", "ct", "co", "c", "dt", "do", "ds"]
    entry = lambda df, key, **own: df.select(key.alias("k"), *[(own.get(c) if c in own else F.lit(0)).cast("long").alias(c) for c in columns])
    facts = entry(counts.filter(F.col("kind") == SECOND), F.col("w"), st=t, so=o)
    facts = facts.unionByName(entry(counts.filter(F.col("kind") == FIRST), F.col("v"), ft=t, fo=o))
    # a word has as many left neighbours as pairs, less the repetitions of each
    facts = facts.unionByName(entry(again, F.col("w"), ct=more(t, 1), co=more(o, 1), c=more(n, 1)))
    facts = facts.unionByName(entry(again, F.col("v"), dt=more(t, D), do=more(o, D), ds=more(n, D0)))
    facts = facts.groupBy("k").agg(*[F.sum(c).alias(c) for c in columns])
    facts = facts.withColumns({"lt": F.col("st") - F.col("ct"), "lo": F.col("so") - F.col("co"), "l": F.col("st") + F.col("so") - F.col("c")})
    facts = workspace.materialize(facts, "facts")

    cut = lambda c, d: F.sum(F.least(F.col(c), F.lit(d)))
    total = facts.agg(F.sum("lt").alias("lt"), F.sum("lo").alias("lo"), F.sum("l").alias("l"), cut("lt", D).alias("ct"), cut("lo", D).alias("co"), cut("l", D0).alias("c"), F.count_if(F.col("l") > 0).alias("kinds")).first()
    both = bool(total["lt"] and total["lo"])
    g = {c: total["c" + c] / max(total["l" + c] or 0, 1) if both else 1.0 for c in "to"}
    whole = max(total["l"] or 0, 1)
    shared = more(F.col("l"), D0) / float(whole) + (total["c"] or 0) / whole / (total["kinds"] + 1)
    tilt = lambda c: more(F.col("l" + c), D) / float(max(total["l" + c] or 0, 1)) / shared + float(g[c])
    ratio = lambda a, b: F.round(F.log(a) - F.log(b), 9) if both else F.lit(0.0)
    words = facts.filter("l > 0").select("k", F.col("l").alias("n"), shared.alias("s"), tilt("t").alias("rt"), tilt("o").alias("ro"), "lt", "lo")
    words = workspace.materialize(words, "words")
    word_table = words.filter(F.greatest("lt", "lo") > D).select("k", "n", ratio(F.col("rt"), F.col("ro")).alias("ratio"))

    tilted = workspace.materialize(again.join(words.select(F.col("k").alias("w"), "s", "rt", "ro"), "w"), "tilted")
    z = tilted.groupBy("v").agg(*[F.sum((n - D0) * (F.col("r" + c) - 1)).alias("z" + c) for c in "to"])
    contexts = z.join(facts.select(F.col("k").alias("v"), "ft", "fo", "dt", "do", "ds"), "v")
    f = F.col("ft") + F.col("fo")
    own = {c: 1 - F.col("d" + c) / F.greatest(F.col("f" + c), F.lit(1)) for c in "to"}
    contexts = contexts.select("v", f.alias("f"), "ft", "fo", *[(own[c] / (1 + F.col("z" + c) / f)).alias("g" + c) for c in "to"], (1 - F.col("ds") / f).alias("g"))
    contexts = workspace.materialize(contexts, "contexts")
    context_table = contexts.select(F.col("v").alias("k"), F.col("f").alias("n"), ratio(F.col("gt"), F.col("go")).alias("ratio"))

    strong = tilted.filter(F.greatest("t", "o") > D).join(contexts, "v")
    pooled = (n - D0) / F.col("f") + F.col("g") * F.col("s")
    given = [more(F.col(c), D) / F.greatest(F.col("f" + c), F.lit(1)) + F.col("g" + c) * pooled * F.col("r" + c) for c in "to"]
    pair_table = strong.select("v", "w", n.alias("n"), ratio(*given).alias("ratio"))
    tables = tuple(workspace.materialize(x, name) for x, name in ((word_table, "word_ratios"), (context_table, "context_ratios"), (pair_table, "pair_ratios")))
    for used in (counts, facts, words, tilted, contexts):
        workspace.drop(used)
    return tables, round(float(np.log(g["t"] / g["o"])), 9) if both else 0.0, both


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(x) * w * np.array([0, *[1 / len(x)] * (len(w) - 1)])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (ridge + 1e-9)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts over all labelled rows of the counting folds, turned into log-likelihood ratios, then calibrated."""
    spark = docs.sparkSession
    workspace.ship(spark)
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("lid")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    marks = workspace.materialize(marks.withColumn("fold", fold(F.col("lid"))).filter("fold != 0"), "labels")
    small = F.broadcast if marks.count() <= BROADCAST_LABELS else (lambda df: df)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with_label = lambda m: rows.join(small(m), F.col("doc_id") == F.col("lid")).select("doc_id", "text", "toxic")
    counted = with_label(marks.filter(F.col("fold") != FOLDS - 1))

    tables, unknown, both = kneser_ney(counted.select("text", "toxic"))
    bounds = (HEAD_WORDS, HEAD_WORDS, HEAD_PAIRS)
    keys = (["k"], ["k"], ["v", "w"])
    unsigned = lambda c: c.to_numpy().view(_U)
    held, tails, all_held = [], [], True
    for table, key, bound in zip(tables, keys, bounds, strict=True):
        part = table
        if table.count() > bound:
            all_held = False
            part = workspace.materialize(table.orderBy(F.desc("n"), *key).limit(bound), "head")
        rows_held = part.select(*key, "ratio").toArrow()
        held.append(Table.of(unsigned(rows_held["k"]) if key == ["k"] else _pair_keys(unsigned(rows_held["v"]), unsigned(rows_held["w"])), rows_held["ratio"].to_numpy()))
        tails.append(table.join(part, key, "left_anti").select(*key, "ratio"))
    head = Head(*held, unknown)
    model = Model(head, None if all_held else tuple(tails), np.zeros(2 + len(STRETCHES)), np.zeros(1 + len(STRETCHES)), np.ones(1 + len(STRETCHES)))

    held = marks.filter(F.col("fold") == FOLDS - 1).orderBy(F.xxhash64("lid"), "lid").limit(CALIBRATION_ROWS)

    sample = with_features(with_label(workspace.materialize(held, "calibration")).select("toxic", "text"), model).orderBy("x", "toxic").toPandas()
    base = marks.agg(F.avg("toxic")).first()[0] or 0.0
    if both and sample["toxic"].nunique() == 2:
        x, y = np.stack(sample["x"].to_list()), sample["toxic"].to_numpy(float)
        centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        return replace(model, weights=_logistic((x - centre) / spread, y), centre=centre, spread=spread)
    share = min(max(base, 1e-3), 1 - 1e-3)
    return replace(model, weights=np.array([np.log(share / (1 - share)), *([1.0] * (1 + len(STRETCHES)))]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text, ...)``.

    The score uses the text alone. Null and wordless texts have ratio 0 and get the score that this has. A null doc_id
    is not held out. Equal texts get equal scores; an empty table gives no rows; other columns are ignored.
    """
    workspace.ship(docs.sparkSession)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_features(rows, model).select("doc_id", model.score(F.col("x")).alias("score"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels(doc_id, toxic, ...)`` outside fold 0 and score all of docs. Null labels are left out; a doc_id that is labelled
    twice is toxic if one label says so; without both classes every text gets the share of toxic labels."""
    return score_documents(docs, train(docs, labels))
