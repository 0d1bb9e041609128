"""Token rows, lexicons and file readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_rows(documents: DataFrame) -> DataFrame:
    """doc_id, lang, pos, word: the letter runs of each text."""
    return documents.select("doc_id", "lang", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))


def token_rows(documents: DataFrame) -> DataFrame:
    """doc_id, pos, token: pieces between single spaces and line ends."""
    return documents.select("doc_id", F.posexplode(F.filter(F.split("text", r"[\x20\n]"), lambda t: t != "")).alias("pos", "token"))


def english_counts(documents: DataFrame) -> DataFrame:
    return ascii_counts(documents, "en")


def ascii_counts(documents: DataFrame, lang: str) -> DataFrame:
    """word, n over the texts of a language: lower-case ASCII words."""
    lower = F.lower("word")
    return word_rows(documents.filter(F.col("lang") == lang)).select(lower.alias("word")).filter(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def counts_by_language(documents: DataFrame, langs: tuple[str, ...]) -> DataFrame:
    """lang, word, n: ``ascii_counts`` of several languages in one pass."""
    words = word_rows(documents.filter(F.col("lang").isin(*langs))).select("lang", F.lower("word").alias("word"))
    return words.filter(F.col("word").rlike("^[a-z]+$")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def lexicon(documents: DataFrame, least: int = 5) -> DataFrame:
    return ranked_lexicon(english_counts(documents), least)


def ranked_lexicon(counts: DataFrame, least: int = 5) -> DataFrame:
    """word, n, rank, freq: words of ``counts(word, n)`` seen ``least`` times, ranked by count, frequency from rank.

    The rank is a running count over histogram bins of n and the first letters, so only words that share both are ever ordered together."""
    words = counts.filter(F.col("n") >= least).withColumn("head", F.substring("word", 1, 3))
    bins = words.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    above = bins.select("n", (F.sum("k").over(Window.orderBy(F.desc("n"))) - F.col("k")).alias("above"), F.sum("k").over(Window.partitionBy()).alias("total"))
    heads = words.groupBy("n", "head").agg(F.count(F.lit(1)).alias("k"))
    before = heads.select("n", "head", (F.sum("k").over(Window.partitionBy("n").orderBy("head")) - F.col("k")).alias("before"))
    place = F.row_number().over(Window.partitionBy("n", "head").orderBy("word"))
    ranked = words.join(F.broadcast(above), "n").join(before, ["n", "head"]).withColumn("rank", F.col("above") + F.col("before") + place)
    return ranked.select("word", "n", F.col("rank").cast("long").alias("rank"), T.rank_frequency(F.col("rank"), F.col("total")).alias("freq"))


def read_ranked_words(spark: SparkSession, path: str, sep: str = " ", header: bool = False, noise: list[str] | None = None) -> DataFrame:
    """word, rank, freq of a rank-ordered word file: rank counts all data lines; words with other characters and noise go,
    the first of equal words stays."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line")).filter("line != ''")
    if header:
        lines = lines.filter("pos > 0")
    ranked = lines.select(T.lookup_key(F.substring_index("line", sep, 1)).alias("word"), (F.col("pos") + (0 if header else 1)).alias("rank"))
    total = F.lit(ranked.agg(F.max("rank")).first()[0])
    clean = ranked.filter(F.col("word").rlike("^[a-zа-яё]+$") & ~F.col("word").isin(*(noise or [""])))
    first = clean.groupBy("word").agg(F.min("rank").alias("rank"))
    return first.select("word", "rank", T.rank_frequency(F.col("rank"), total).alias("freq"))


def read_dic(spark: SparkSession, path: str) -> DataFrame:
    """word of a dictionary file with affix flags: blanks, comments and counts go, flags are cut."""
    v = F.trim("value")
    return spark.read.text(path).select(v.alias("value")).filter("value != '' and not value rlike '^#' and not value rlike '^[0-9]+$'").select(F.substring_index("value", "/", 1).alias("word"))


def read_jsonl_pool(spark: SparkSession, path: str, complete: bool = False) -> DataFrame:
    """id, text, metadata_hex; duplicate ids (and gaps, if ``complete``) are errors."""
    rows = spark.read.schema("id long, text string, metadata_hex string").json(path, mode="FAILFAST")
    n, distinct, low, high = rows.agg(F.count("id"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
    if n != distinct:
        raise ValueError(f"{n - distinct} repeated ids")
    if complete and n and (low != 0 or high != n - 1):
        raise ValueError(f"ids run from {low} to {high}, not from 0 to {n - 1}")
    return rows


def read_held_out(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="input string, expected string, language string, decision string")


def read_json_list(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).na.drop(subset=required)


def write_sorted_words(words: DataFrame, path: str) -> None:
    """Distinct normalised words, range-sorted, so that readers skip row groups by their bounds."""
    keys = words.select(T.lookup_key(F.col("word")).alias("word")).filter("word != ''").distinct()
    keys.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
