"""Audits: seeded slips and their recovery, provider comparison, set differences, early prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import edits as E
from lexiloom.operators import candidates as C


def seeded_slips(lexicon: DataFrame, seed: int = 1) -> DataFrame:
    """word, slip, mutation: one slip per word of ``lexicon(word, n)``, chosen and placed by its count and the seed."""
    w, n = F.col("word"), F.length("word")
    kind = F.pmod(F.col("n") + seed, F.lit(3))
    at = F.pmod(F.col("n") * 7 + seed, n).cast("int")
    inner = F.pmod(F.col("n") * 7 + seed, n - 1).cast("int")
    pick = F.when(kind == 0, F.get(E.deletions(w), at)).when(kind == 1, F.get(E.transpositions(w), inner)).otherwise(F.concat(w.substr(F.lit(1), at + 1), w.substr(at + 1, n)))
    name = F.when(kind == 0, "delete").when(kind == 1, "swap").otherwise("repeat")
    return lexicon.select("word", name.alias("slip"), pick.alias("mutation")).filter("mutation != word")


def recovery(slips: DataFrame, lexicon: DataFrame, classify=C.classify_mutations) -> DataFrame:
    """slip, outcome, n: whether the intended word is the unique target of its mutation."""
    known = lexicon.select(F.col("word").alias("known"))
    open_ = slips.select(F.col("mutation").alias("token")).distinct().join(C.sized(known), F.col("token") == F.col("known"), "left_anti")
    found = classify(C.mutation_sources(C.one_edit_pairs(open_, lexicon, ("freq",)), lexicon)).select("token", "class", "target")
    out = slips.join(found, F.col("mutation") == F.col("token"), "left").join(C.sized(known), F.col("mutation") == F.col("known"), "left")
    outcome = (
        F.when(F.col("known").isNotNull(), "valid_word").when(F.col("class").isNull(), "no_source").when(F.col("class") == "Ambiguous", "ambiguous")
        .when(F.col("target") == F.col("word"), "recovered").otherwise("wrong")
    )
    return out.groupBy("slip", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def compare_providers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counters over two results (token, target): agreement, difference, and what only one of them says."""
    x, y = a.filter("target is not null").toDF("token", "ta"), b.filter("target is not null").toDF("token", "tb")
    j = x.join(y, "token", "full_outer")
    both = F.col("ta").isNotNull() & F.col("tb").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("tokens"), F.count_if(both & (F.col("ta") == F.col("tb"))).alias("agree"), F.count_if(both & (F.col("ta") != F.col("tb"))).alias("differ"),
        F.count_if(F.col("tb").isNull()).alias("only_a"), F.count_if(F.col("ta").isNull()).alias("only_b"),
    )


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """side, n: rows of two key sets that both have, or only one."""
    sides = a.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    merged = sides.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy(F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, "left").otherwise("right").alias("side")).agg(F.count(F.lit(1)).alias("n"))


def outcome_matrix(a: DataFrame, b: DataFrame, outcomes: list[str]) -> DataFrame:
    """Decisions of one provider in rows, of another in columns, over (token, decision) rows."""
    j = a.select("token", F.col("decision").alias("first")).join(b.select("token", F.col("decision").alias("second")), "token")
    return j.groupBy("first").pivot("second", outcomes).agg(F.count(F.lit(1))).na.fill(0)


def early_prefix_audit(train: DataFrame, test: DataFrame, margins: list[int], shortest: int = 4, longest: int = 10) -> DataFrame:
    """least, length, n: at which prefix length test words first have a prefix that ``least`` train words share; null where they never do."""
    sizes = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest)))
    seen = train.select(F.explode(F.transform(sizes, lambda k: F.col("word").substr(F.lit(1), k))).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("c"))
    asked = test.filter(F.length("word") >= shortest).select("word", F.explode(F.sequence(F.lit(shortest), F.least(F.length("word"), F.lit(longest)))).alias("k"))
    hits = asked.withColumn("prefix", F.expr("substr(word, 1, k)")).join(seen, "prefix", "left")
    each = hits.select("word", "k", F.coalesce("c", F.lit(0)).alias("c"), F.explode(F.array(*[F.lit(m) for m in margins])).alias("least"))
    first = each.groupBy("least", "word").agg(F.min(F.when(F.col("c") >= F.col("least"), F.col("k"))).alias("length"))
    return first.groupBy(F.col("least").cast("long").alias("least"), F.col("length").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))
