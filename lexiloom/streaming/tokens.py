"""Per-key token state over input events, as a stream and as its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiloom.sources.shared import ship

LONGEST = 48


def as_input(events: DataFrame) -> DataFrame:
    """event_id, ts, key, kind, ch from event rows."""
    kind = F.when(F.col("event_id") % 7 == 0, "Boundary").when(F.col("event_id") % 23 == 0, "Reset").when(F.col("event_id") % 11 == 0, "Backspace").otherwise("Character")
    ch = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.col("event_id") % 26 + 1).cast("int"), F.lit(1))
    return events.select("event_id", "ts", F.col("user_id").alias("key"), kind.alias("kind"), ch.alias("ch"))


def _fold(items: Column) -> Column:
    """The token that a run of character and backspace events spells; overflow clears it."""
    step = lambda s, e: F.when(e["kind"] == "Backspace", s.substr(F.lit(1), F.greatest(F.length(s) - 1, F.lit(0)))).when(F.length(s) >= LONGEST, F.lit("")).otherwise(F.concat(s, e["ch"]))
    return F.aggregate(items, F.lit(""), step)


def completed_tokens(inputs: DataFrame) -> DataFrame:
    """key, event_id, token: what stands in the buffer at each boundary, if anything. A boundary or reset starts a new run."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    cut = F.col("kind").isin("Boundary", "Reset")
    runs = inputs.withColumn("run", F.sum(F.lag(cut.cast("int"), 1, 0).over(order)).over(order))
    item = F.struct("ts", "event_id", "kind", "ch")
    grouped = runs.groupBy("key", "run").agg(
        F.array_sort(F.collect_list(F.when(~cut, item))).alias("items"), F.max(F.when(F.col("kind") == "Boundary", F.col("event_id"))).alias("event_id")
    )
    return grouped.filter("event_id is not null").select("key", "event_id", _fold(F.col("items")).alias("token")).filter("token != ''")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    token = state.get[0] if state.exists else ""
    out = []
    for frame in frames:
        for e in frame.sort_values(["ts", "event_id"]).itertuples():
            if e.kind == "Boundary":
                if token:
                    out.append((key[0], e.event_id, token))
                token = ""
            elif e.kind == "Reset":
                token = ""
            elif e.kind == "Backspace":
                token = token[:-1]
            else:
                token = "" if len(token) >= LONGEST else token + e.ch
    state.update((token,))
    yield pd.DataFrame(out, columns=["key", "event_id", "token"])


def stream_tokens(inputs: DataFrame) -> DataFrame:
    """completed_tokens over a stream of input rows; the state of a key is its unfinished token."""
    ship(inputs.sparkSession)
    return inputs.groupBy("key").applyInPandasWithState(_advance, "key long, event_id long, token string", "token string", "append", GroupStateTimeout.NoTimeout)
