"""What a session remembers: the last words, and corrections that can still be undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prediction_contexts(words: DataFrame, frame: int = 8, chars: int = 256) -> DataFrame:
    """doc_id, pos, context: up to ``frame`` last words, as many as fit into ``chars`` characters with one blank between."""
    over = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1 - frame, 0)
    last = F.collect_list("word").over(over)
    text = lambda n: F.array_join(F.slice("last", F.size("last") - n + 1, n), " ")
    sizes = F.filter(F.sequence(F.lit(1), F.size("last")), lambda n: F.length(text(n)) <= chars)
    out = words.withColumn("last", last).withColumn("n", F.array_max(sizes))
    return out.select("doc_id", "pos", F.coalesce(text(F.col("n")), F.lit("")).alias("context"))


def undone(events: DataFrame, ttl_ms: int = 30_000) -> DataFrame:
    """event_id, undo_id, age_ms of corrections whose next event of the key is an undo within the time to live."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.withColumn("at", micros)
    for name in ("kind", "event_id", "at"):
        rows = rows.withColumn(f"next_{name}", F.lead(name).over(order))
    rows = rows.withColumn("age_ms", (F.col("next_at") - F.col("at")) / 1000)
    hit = (F.col("kind") == "Correction") & (F.col("next_kind") == "Undo") & (F.col("age_ms") <= ttl_ms)
    return rows.filter(hit).select("event_id", F.col("next_event_id").alias("undo_id"), "age_ms")


def suppress_rejected(corrections: DataFrame, rejections: DataFrame, least: int = 2) -> DataFrame:
    """Corrections (candidate, replacement, kind, ...) that were not undone ``least`` times or more."""
    key = ["kind", "candidate", "replacement"]
    often = rejections.groupBy(*key).agg(F.sum("undo_count").alias("undone")).filter(F.col("undone") >= least)
    return corrections.join(often, key, "left_anti")
