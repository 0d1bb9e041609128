"""Punctuation proposals and spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: first words of questions, words that take a comma before them
QUESTION_STARTS = ("who", "what", "where", "when", "why", "how", "which", "can", "could", "would", "should", "is", "are", "do", "does", "did")
COMMA_BEFORE = ("but", "however", "although", "if", "when", "because", "which", "that")


def _bare(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, "^['’\"]+|['’\"]+$", ""))


def proposals(texts: DataFrame) -> DataFrame:
    """id, after_token, mark, probability: an end mark by the first word, and commas before conjunctions."""
    t = texts.withColumn("tok", F.filter(F.split("text", " "), lambda x: x != "")).filter(F.size("tok") > 0)
    t = t.withColumn("bare", F.transform("tok", _bare))
    asks = F.get("bare", F.lit(0)).isin(*QUESTION_STARTS)
    end = F.array(F.struct((F.size("tok") - 1).alias("after_token"), F.when(asks, "?").otherwise(".").alias("mark"), F.when(asks, 0.94).otherwise(0.92).alias("probability")))
    at = F.filter(F.sequence(F.lit(0), F.size("bare") - 1), lambda i: (i > 0) & F.get("bare", i).isin(*COMMA_BEFORE) & (F.length(F.get("bare", i - 1)) > 1) & ~F.get("bare", i - 1).isin(*COMMA_BEFORE))
    commas = F.transform(at, lambda i: F.struct((i - 1).alias("after_token"), F.lit(",").alias("mark"), F.lit(0.92).alias("probability")))
    return t.select("id", F.explode(F.concat(end, commas)).alias("p")).select("id", F.col("p.after_token").cast("long").alias("after_token"), "p.mark", "p.probability")


def select_proposals(rows: DataFrame, least: float = 0.90) -> DataFrame:
    """Per place the likeliest proposal, ties to the lowest mark."""
    best = F.min(F.struct((-F.col("probability")).alias("m"), "mark"))
    fit = rows.filter((F.col("probability") >= least) & (F.col("probability") <= 1) & (F.col("after_token") >= 0))
    return fit.groupBy("id", "after_token").agg(best.alias("b")).select("id", "after_token", F.col("b.mark").alias("mark"), (-F.col("b.m")).alias("probability"))


def apply_proposals(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """id, text with each chosen mark behind its token."""
    marks = chosen.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("after_token", "mark"))).alias("marks"))
    t = texts.withColumn("tok", F.filter(F.split("text", " "), lambda x: x != "")).join(marks, "id", "left")
    put = F.transform("tok", lambda w, i: F.concat(w, F.coalesce(F.try_element_at("marks", i.cast("long")), F.lit(""))))
    return t.select("id", F.array_join(put, " ").alias("text"))


def close_up(text: Column) -> Column:
    """One space between a letter and a mark goes, unless a space, a digit or another mark follows the other way."""
    return F.regexp_replace(text, r"(\p{L}) ([.,;:!?])(?=\s|$)", "$1$2")
