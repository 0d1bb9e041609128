"""Word and character n-gram models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.sources.shared import stored

START = "^"


def _runs(documents: DataFrame, n: int) -> DataFrame:
    """w1, ..., wn, n over the runs of n words of ``documents(text)``, in lower case. Runs are built inside each row, so only counts are shuffled."""
    words = documents.select(F.transform(T.words(F.col("text")), F.lower).alias("ws"))
    last = F.slice("ws", n, F.size("ws"))  # the last words of the runs; the k-th one before stands k places earlier
    runs = F.transform(last, lambda w, i: F.struct(*[F.get("ws", i + k).alias(f"w{k + 1}") for k in range(n - 1)], w.alias(f"w{n}")))
    return words.filter(F.size("ws") >= n).select(F.explode(runs).alias("r")).select("r.*").groupBy(*[f"w{k + 1}" for k in range(n)]).agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(documents: DataFrame) -> DataFrame:
    return _runs(documents, 2)


def trigram_counts(documents: DataFrame) -> DataFrame:
    return _runs(documents, 3)


def best_continuations(counts: DataFrame, context: list[str], word: str, least: int) -> DataFrame:
    """The most frequent continuation of each context seen ``least`` times; ties to the smaller word."""
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(word).alias("w")))
    out = counts.groupBy(*context).agg(F.sum("n").alias("total"), best.alias("b")).filter(F.col("total") >= least)
    return out.select(*context, "total", F.col("b.w").alias("best"), (-F.col("b.m")).alias("n"))


def continue_contexts(contexts: DataFrame, bi: DataFrame, tri: DataFrame) -> DataFrame:
    """For contexts(w1, w2): the trigram model's word if it knows the context, else the bigram model's."""
    t = tri.select("w1", "w2", F.col("best").alias("t_best"))
    b = bi.select(F.col("w1").alias("w2"), F.col("best").alias("b_best"))
    return contexts.join(t, ["w1", "w2"], "left").join(b, "w2", "left").select("w1", "w2", F.coalesce("t_best", "b_best").alias("best"), F.when(F.col("t_best").isNotNull(), 3).when(F.col("b_best").isNotNull(), 2).cast("long").alias("order"))


def continuations(documents: DataFrame, least: int) -> DataFrame:
    """w1, w2, best, order for every pair of words in a row: as ``continue_contexts`` over the models of the same texts, in one pass.

    The runs of three words, with none after a text's last word, give the counts of pairs, too: their sum over third words."""
    words = documents.select(F.transform(T.words(F.col("text")), F.lower).alias("ws"))
    runs = F.transform(F.slice("ws", 2, F.size("ws")), lambda w, i: F.struct(F.get("ws", i).alias("w1"), w.alias("w2"), F.get("ws", i + 2).alias("w3")))
    tri = words.filter(F.size("ws") >= 2).select(F.explode(runs).alias("r")).select("r.*").groupBy("w1", "w2", "w3").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("w3").isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("n")).alias("m"), F.col("w3").alias("w"))))
    pairs = tri.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.sum(F.when(known, F.col("n"))).alias("total"), best.alias("b"))
    pairs = stored(pairs.select("w1", "w2", "n", F.when(F.col("total") >= least, F.col("b.w")).alias("t_best")), "pairs")
    bi = best_continuations(pairs, ["w1"], "w2", least).select(F.col("w1").alias("w2"), F.col("best").alias("b_best"))
    order = F.when(F.col("t_best").isNotNull(), 3).when(F.col("b_best").isNotNull(), 2).cast("long").alias("order")
    return pairs.join(bi, "w2", "left").select("w1", "w2", F.coalesce("t_best", "b_best").alias("best"), order)


def prefix_counts(lexicon: DataFrame, longest: int = 10) -> DataFrame:
    """prefix, n: distinct words with each prefix of up to ``longest`` letters."""
    sizes = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest)))
    return lexicon.select(F.explode(F.transform(sizes, lambda k: F.col("word").substr(F.lit(1), k))).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


def character_trigrams(lexicon: DataFrame, letters: int = 34, alpha: float = 0.1, beta: float = 2.0) -> DataFrame:
    """a, b, c, logp of the trigrams seen in ``lexicon(word, weight)``: trigram over bigram over unigram, each with its prior mass."""
    padded = F.concat(F.lit(START * 2), F.col("word"))
    rows = lexicon.select("weight", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: padded.substr(i, F.lit(3)))).alias("t"))
    rows = rows.select("weight", *[F.substring("t", i + 1, 1).alias(c) for i, c in enumerate("abc")])
    tri = rows.groupBy("a", "b", "c").agg(F.sum("weight").alias("n"))
    w = lambda value, *keys: F.sum(value).over(Window.partitionBy(*keys))
    tri = tri.withColumn("nb", w("n", "b", "c")).withColumn("tb", w("n", "b")).withColumn("nc", w("n", "c")).withColumn("tt", w("n")).withColumn("ta", w("n", "a", "b"))
    uni = (F.col("nc") + alpha) / (F.col("tt") + letters * alpha)
    bi = (F.col("nb") + beta * uni) / (F.col("tb") + beta)
    return tri.select("a", "b", "c", F.log((F.col("n") + beta * bi) / (F.col("ta") + beta)).alias("logp"))


def mean_log_likelihood(words: DataFrame, trigrams: DataFrame, unseen: float = -8.0) -> DataFrame:
    """word, mean_logp, n over the trigrams of each of ``words(word)``; ``unseen`` stands for trigrams that the model does not have."""
    padded = F.concat(F.lit(START * 2), F.col("word"))
    rows = words.filter("word != ''").select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: padded.substr(i, F.lit(3)))).alias("t"))
    model = trigrams.select(F.concat("a", "b", "c").alias("t"), "logp")
    return rows.join(model, "t", "left").groupBy("word").agg(F.avg(F.coalesce("logp", F.lit(unseen))).alias("mean_logp"), F.count(F.lit(1)).alias("n"))
