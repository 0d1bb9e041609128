"""Quality rules: base text statistics, then robust multivariate outliers per language and source.

The minimum-covariance-determinant estimate is found as FAST-MCD does for large samples: starts on
a seeded sample of each group, then concentration steps over all of the group's documents until the determinant rests, then
reweighting steps over the rows within the 97.5 % ellipsoid. A step is one aggregation: rows are binned by log distance, and
each (group, bin) keeps a count, sums and products, so a group of any size is never gathered.

Statistics are brought to scales on which clean text is near normal, with the same spread at any length: a power of the number of words;
the mean word length, centred at the group's median, times the root of the words; and roots of the three counts (symbols,
repeated lines, repeated passages) less those of the group's usual rate. On the root scale a Poisson count has variance 1; no estimate is let
claim less, so a count is an outlier only beyond its own counting noise, even where all other texts have none.
A group's estimate is drawn to that of all rows with the weight of SHRINK documents, and that to the plain covariance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import workspace
from lexiloom.llm.textkernel import _SPACE, slices, string_buffers, window_hashes, word_bounds, word_hashes

P = 5
#: Rows of a group that seed the estimate (expected number; the steps after it use all rows).
SEED_ROWS = 2000
#: Share of a group that the estimate is made from: 0.5 withstands the most outliers.
COVERAGE = 0.5
#: Documents by which a group's estimate is drawn towards that of all rows.
SHRINK = 50
#: Concentration steps at most, the change of log determinants at which they end, and reweighting steps.
STEPS, SETTLED, REWEIGHTS = 12, 0.02, 2
#: Power of the number of words.
POWER = -0.2
#: Variance of a Poisson count on the root scale.
NOISE = 1.0
#: Added to every variance, so that collinear rows can be inverted.
RIDGE = 1e-4
#: Share of a group's words (to the count's power), by rate, that its usual rates of counts are taken from.
USUAL = 0.75
TAIL = 1e-4
WITHIN = 0.975
_BINS = 16
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_COUNTED = _BASE + ", n_repeats long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _chi2_cdf(x: float, k: float) -> float:
    term = total = 1 / math.gamma(k / 2 + 1)
    n = 1
    while term > total * 1e-15:
        term *= (x / 2) / (k / 2 + n)
        total += term
        n += 1
    return total * (x / 2) ** (k / 2) * math.exp(-x / 2)


def chi2_quantile(p: float, k: float) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def text_statistics(part: pa.RecordBatch) -> list[pa.Array]:
    """The five base counts of each text of a batch, and its runs of repeated words."""
    buf, offs = string_buffers(part.column("text"))
    starts, ends, first = word_bounds(buf, offs)
    words = word_hashes(buf, starts, ends, lower=False)
    upto = lambda hit: np.concatenate([[0], np.cumsum(hit)])[offs]
    chars = np.diff(upto(((buf & 0xC0) != 0x80) & ~_SPACE[buf]))
    symbols = np.diff(upto(_SYMBOL[buf]))
    dup_lines, repeats, runs = [], [], []
    raw = buf.tobytes()
    for i in range(len(offs) - 1):
        lines = [x for x in raw[offs[i] : offs[i + 1]].split(b"\n") if x and not x.isspace()]
        dup_lines.append(len(lines) - len(set(lines)))
        w = words[first[i] : first[i + 1]]
        covered = np.zeros(len(w), bool)
        if len(w) > 3:
            _, at, count = np.unique(window_hashes(w, 3), return_inverse=True, return_counts=True)
            twice = count[at] > 1
            for k in range(3):
                covered[k : k + len(twice)] |= twice
        repeats.append(int(covered.sum()))
        runs.append(int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum()))
    return [pa.array(x, pa.int64()) for x in (np.diff(first), chars, symbols, dup_lines, repeats, runs)]


def _statistics(batches):
    for batch in batches:
        for part in slices(batch):
            keep = [part.column(c) for c in ("doc_id", "grp", "text_key")]
            yield pa.RecordBatch.from_arrays(keep + text_statistics(part), names=["doc_id", "grp", "text_key", *[x.split()[0] for x in _COUNTED.split(", ")]])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, grp (language and source; nulls are values), text_key (a hash of the text), base counts."""
    workspace.ship(docs.sparkSession)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.concat(name("lang"), F.lit("\n"), name("source")).alias("grp"))
    return rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(_statistics, f"doc_id long, grp string, text_key long, {_COUNTED}")


#: Counts, and the power of the number of words that they are held against: chance repeats of passages grow faster than the text.
_RATES = {"n_symbols": 1.0, "n_dup_lines": 1.0, "n_repeats": 1.5}


def usual(usable: DataFrame) -> DataFrame:
    """g, m (median log word length) and r0, r1, r2 (usual rates of the three counts) of each group of ``usable(g, k, counts)``,
    drawn to those of all rows. Medians and the share by rate are taken from histograms of all rows."""
    n = F.col("n_words")
    bins = [F.round(F.log(F.col("word_chars") / n) * 500)] + [F.ceil(F.sqrt(F.col(c) / F.pow(n, F.lit(e))) * 5000) for c, e in _RATES.items()]
    long = F.posexplode(F.array(*[F.struct(b.cast("long").alias("bin"), k.alias("c")) for b, k in zip(bins, [F.lit(0).cast("long"), *map(F.col, _RATES)], strict=True)]))
    rows = usable.select("g", n, long.alias("what", "x")).select("g", "n_words", "what", "x.bin", "x.c")
    against = F.pow(n, F.element_at(F.array(F.lit(1.0), *map(F.lit, _RATES.values())), F.col("what") + 1))
    histogram = rows.groupBy("g", "what", "bin").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"), F.sum(against).alias("n"))
    upto = Window.partitionBy("g", "what").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    histogram = histogram.withColumn("weight", F.when(F.col("what") == 0, F.col("k")).otherwise(F.col("n")))
    every = Window.partitionBy("g", "what")
    histogram = histogram.withColumns({"before": F.sum("weight").over(upto) - F.col("weight"), "all": F.sum("weight").over(every), "size": F.sum("k").over(every)})
    share = F.when(F.col("what") == 0, 0.5).otherwise(USUAL)
    low = histogram.filter(F.col("before") < share * F.col("all"))
    own = low.groupBy("g").agg(
        F.max("size").alias("k"),
        (F.max(F.when(F.col("what") == 0, F.col("bin"))) / 500).alias("m"),
        *[(F.sum(F.when(F.col("what") == i + 1, F.col("c"))) / F.sum(F.when(F.col("what") == i + 1, F.col("n")))).alias(f"r{i}") for i in range(3)],
    )
    own = workspace.materialize(own, "usual")
    whole = own.filter("g = '*'").first()
    weight = F.col("k") / (F.col("k") + SHRINK)
    mixed = lambda c: F.round(weight * F.col(c) + (1 - weight) * float(whole[c] if whole else 0), 12).alias(c)
    return own.select("g", mixed("m"), *[mixed(f"r{i}") for i in range(3)])


def _features() -> list:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    root = lambda c, r: 2 * (F.sqrt(F.col(c) + 0.375) - F.sqrt(F.col(r) * F.pow(n, F.lit(_RATES[c])) + 0.375))
    return [F.pow(n, F.lit(POWER)) * 20, F.sqrt(n) * (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n) - F.col("m")), *[root(c, f"r{i}") for i, c in enumerate(_RATES)]]


def _regular(cov: np.ndarray) -> np.ndarray:
    """The covariance with no direction among the counts below counting noise."""
    own, axes = np.linalg.eigh(cov[P - len(_RATES) :, P - len(_RATES) :])
    out = cov + RIDGE * np.eye(P)
    out[P - len(_RATES) :, P - len(_RATES) :] += (axes * np.maximum(NOISE - own, 0)) @ axes.T
    return out


def _row(grp: str, k: float, mean: np.ndarray, cov: np.ndarray, before: float = 0.0) -> pd.DataFrame:
    return pd.DataFrame({"g": [grp], "k": [float(k)], "mean": [np.round(mean, 9).tolist()], "cov": [np.round(cov.ravel(), 9).tolist()], "before": [float(before)]})


#: before: the log determinant of the estimate that a step started from.
_FIT = "g string, k double, mean array<double>, cov array<double>, before double"


def fit_sample(x: np.ndarray, starts: int = 20, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and raw covariance of the half with the least determinant found from random starts."""
    rng = np.random.default_rng(seed)
    h = max(1, math.ceil(COVERAGE * len(x)))
    best = None
    for k in range(starts):
        at = rng.choice(len(x), min(len(x), P + 1), replace=False) if k else np.argsort(np.abs(x - np.median(x, axis=0)).sum(axis=1))[:h]
        for _ in range(6):
            mean, cov = x[at].mean(axis=0), np.cov(x[at].T, bias=True) if len(at) > 1 else np.zeros((P, P))
            d = x - mean
            at = np.argsort(np.einsum("ni,ij,nj->n", d, np.linalg.inv(_regular(cov)), d), kind="stable")[:h]
        mean, cov = x[at].mean(axis=0), np.cov(x[at].T, bias=True) if len(at) > 1 else np.zeros((P, P))
        det = np.linalg.slogdet(_regular(cov))[1]
        if best is None or det < best[0] - 1e-12:
            best = det, mean, cov
    return best[1:]


def consistency(share: float) -> float:
    """What the covariance of the inner share of normal rows is multiplied by."""
    return share / _chi2_cdf(chi2_quantile(share, P), P + 2)


def _start(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["u", *[f"x{i}" for i in range(P)]])
    mean, cov = fit_sample(pdf[[f"x{i}" for i in range(P)]].to_numpy(float))
    return _row(pdf["g"].iloc[0], pdf["k"].iloc[0], mean, cov * consistency(COVERAGE))


def _moments(pdf: pd.DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(pdf["n"].to_numpy(float)[:rows].sum(), 1)
    mean = np.array([pdf[f"s{i}"].to_numpy()[:rows].sum() / n for i in range(P)])
    cov = np.zeros((P, P))
    for i in range(P):
        for j in range(i, P):
            cov[i, j] = cov[j, i] = pdf[f"q{i}{j}"].to_numpy()[:rows].sum() / n - mean[i] * mean[j]
    return mean, cov


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bin")
    count = pdf["n"].to_numpy(float)
    mean, cov = _moments(pdf, int(np.searchsorted(np.cumsum(count), COVERAGE * count.sum())) + 1)
    return _row(pdf["g"].iloc[0], count.sum(), mean, cov * consistency(COVERAGE), pdf["det"].iloc[0])


def _reweight(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bin")
    limit = math.floor(math.log(chi2_quantile(WITHIN, P) + 1e-6) * _BINS)
    mean, cov = _moments(pdf, max(1, int((pdf["bin"] <= limit).sum())))
    return _row(pdf["g"].iloc[0], pdf["n"].sum(), mean, cov * consistency(WITHIN), pdf["det"].iloc[0])


def _drawn(fit: DataFrame, name: str, plain: np.ndarray) -> tuple[DataFrame, float]:
    """g, mean, inv, det: the estimates drawn to that of all rows, that one to the plain covariance; inverted.
    And the largest change of a log determinant in the step that made them."""
    parts = {"k": F.col("k")} | {f"mean{i}": F.get("mean", F.lit(i)) for i in range(P)} | {f"cov{i}": F.get("cov", F.lit(i)) for i in range(P * P)}
    fit, whole = workspace.observed(fit, name, *[F.max(F.when(F.col("g") == "*", x)).alias(n) for n, x in parts.items()])
    some = whole["k"] is not None
    weight = whole["k"] / (whole["k"] + SHRINK) if some else 0.0
    centre = np.array([whole[f"mean{i}"] for i in range(P)]) if some else np.zeros(P)
    spread = weight * np.array([whole[f"cov{i}"] for i in range(P * P)]).reshape(P, P) + (1 - weight) * plain if some else plain

    def run(frames):
        for pdf in frames:
            out = []
            for g, k, mean, cov, before in zip(pdf["g"], pdf["k"], pdf["mean"], pdf["cov"], pdf["before"], strict=True):
                w = k / (k + SHRINK) if g != "*" else 0.0
                full = _regular(w * np.array(cov).reshape(P, P) + (1 - w) * spread)
                out.append((g, np.round(w * np.array(mean) + (1 - w) * centre, 9).tolist(), np.round(np.linalg.inv(full).ravel(), 9).tolist(), round(float(np.linalg.slogdet(full)[1]), 9), before))
            yield pd.DataFrame(out, columns=["g", "mean", "inv", "det", "before"])

    drawn = fit.mapInPandas(run, "g string, mean array<double>, inv array<double>, det double, before double")
    drawn, seen = workspace.observed(drawn, "fit", F.max(F.abs(F.col("det") - F.col("before"))).alias("change"))
    return drawn.drop("before"), seen["change"] or 0.0


def _distance():
    d = [F.col(f"x{i}") - F.get("mean", F.lit(i)) for i in range(P)]
    return sum((F.get("inv", F.lit(i * P + j)) * d[i] * d[j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, distance and text_key for every row of
    ``docs(doc_id, text, lang, source, ...)``.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows.
    The others are kept unless their statistics lie beyond the 1 - TAIL chi-square quantile of the
    squared Mahalanobis distance from their group's robust centre. Null texts have no words and
    fail; null languages and sources form groups of their own; small groups lean on the estimate over
    all rows; equal rows get equal results; an empty table gives no rows.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = workspace.materialize(statistics(docs).withColumn("base_failed", failed), "statistics")
    usable = table.filter("not base_failed").select("doc_id", F.col("grp").alias("g"), *[x.split()[0] for x in _COUNTED.split(", ")])
    levels = workspace.materialize(usual(usable.unionByName(usable.withColumn("g", F.lit("*")))), "levels")
    sizes = usable.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    placed = usable.join(levels, "g").join(sizes, "g").select("doc_id", "g", "k", *[x.alias(f"x{i}") for i, x in enumerate(_features())])
    placed = workspace.materialize(placed, "placed")
    columns = [f"x{i}" for i in range(P)]
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i, P)]
    whole = placed.agg(*sums).fillna(0).toPandas()
    plain = _moments(whole, 1)[1]
    both = placed.unionByName(placed.withColumns({"g": F.lit("*"), "k": F.lit(int(whole["n"].iloc[0])).cast("long")}))
    u = F.col("u") * F.col("k") < SEED_ROWS
    unit = F.pmod(F.xxhash64("doc_id", *columns), F.lit(1 << 40)) / float(1 << 40)
    fit, _ = _drawn(both.withColumn("u", unit).filter(u).groupBy("g").applyInPandas(_start, _FIT), "starts", plain)

    def step(fit: DataFrame, make) -> tuple[DataFrame, float]:
        binned = both.join(fit, "g").withColumn("bin", F.floor(F.log(_distance() + 1e-6) * _BINS))
        return _drawn(binned.groupBy("g", "bin").agg(*sums, F.max("det").alias("det")).groupBy("g").applyInPandas(make, _FIT), "moments", plain)

    for _ in range(STEPS):
        fit, change = step(fit, _concentrate)
        if change < SETTLED:
            break
    for _ in range(REWEIGHTS):
        fit, _ = step(fit, _reweight)
    use = table.join(levels.withColumnRenamed("g", "grp"), "grp", "left").join(fit.withColumnRenamed("g", "grp"), "grp", "left")
    use = use.withColumns({f"x{i}": x for i, x in enumerate(_features())}).withColumn("distance", _distance())
    near = F.col("distance").isNull() | (F.col("distance") <= chi2_quantile(1 - TAIL, P))
    base = [x.split()[0] for x in _BASE.split(", ")]
    return use.select("doc_id", *base, "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance", "text_key")
