"""State machines over streams whose events come late: released in order of event time, with state that expires.

``in_order`` keeps the events of a key until the watermark has passed them, then gives them to a machine of ``buffers`` by (ts, event_id), so that
a stream whose events are shuffled across micro-batches reports what the table does. Event-time timers release what waits, and remove
the state of a key that has been quiet for the time to live.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexiloom.sources.shared import ship
from lexiloom.streaming.buffers import _names

#: The state store that timers and lists of state need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UndoWindow:
    """A correction may be undone by the key's next event, within the time to live; anything else ends the window."""

    schema, state_schema = "key long, event_id long, undo_id long, age_ms double", "event_id long, at long"

    def __init__(self, ttl_ms: int = 30_000):
        self.ttl, self.event_id, self.at = ttl_ms, None, 0

    def load(self, state: tuple) -> None:
        self.event_id, self.at = state

    def save(self) -> tuple:
        return self.event_id, self.at

    def step(self, e) -> tuple | None:
        pending, at = self.event_id, self.at
        self.event_id, self.at = (e.event_id, e.us) if e.kind == "Correction" else (None, 0)
        if pending is None or e.kind != "Undo" or e.us - at > self.ttl * 1000:
            return None
        return e.key, pending, e.event_id, (e.us - at) / 1000


class _InOrder(StatefulProcessor):
    def __init__(self, machine: Callable, columns: list[str], schema: str, idle_ms: int):
        self.machine, self.columns, self.schema, self.idle = machine, columns, schema, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.state = handle.getValueState("machine", self.machine().state_schema + ", last_ms long")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # events behind the watermark were released already or missed their turn: they are late by definition
        now = timerValues.getCurrentWatermarkInMs()
        new = [tuple(r) for frame in rows for r in frame[frame["us"] // 1000 >= now][self.columns].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            # the timer of what waits already is not later than that of what waits longer
            us = self.columns.index("us")
            self._timer(min(r[us] for r in self.waiting.get()) // 1000 + 1)
        yield pd.DataFrame(columns=_names(self.machine().schema))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        machine, names = self.machine(), _names(self.machine().schema)
        last = 0
        if self.state.exists():
            *saved, last = self.state.get()
            machine.load(tuple(saved))
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=self.columns)
        due = held[held["us"] // 1000 < now].sort_values(["us", "event_id"])
        left = held[held["us"] // 1000 >= now]
        out = [row for e in due.itertuples(index=False) if (row := machine.step(e)) is not None]
        last = int(due["us"].max()) // 1000 if len(due) else last
        if len(left):
            self.waiting.put([tuple(r) for r in left.itertuples(index=False)])
        else:
            self.waiting.clear()
        if not len(left) and last + self.idle <= now:
            self.state.clear()
        else:
            self.state.update((*machine.save(), last))
            self._timer(int(left["us"].min()) // 1000 + 1 if len(left) else last + self.idle)
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def with_micros(inputs: DataFrame) -> DataFrame:
    """Inputs with ``us``, their event time in microseconds."""
    return inputs.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def in_order(inputs: DataFrame, machine: Callable, delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """What ``machine`` reports over the stream ``inputs(event_id, ts, key, kind, ...)``, whose events may come up to ``delay`` late.

    Events later than that are left out, as the watermark defines. A key's state goes when its last event lies ``idle_ms`` before the watermark, so
    ``idle_ms`` is to be no shorter than what the machine remembers. Null keys and times are left out. Needs the session's state store to be STATE_STORE.
    """
    spark = inputs.sparkSession
    ship(spark)
    rows = with_micros(inputs.filter("key is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")))
    columns = [f.name for f in rows.schema.fields if f.name != "ts"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "ts")
    grouped = rows.withWatermark("ts", delay).groupBy("key")
    return grouped.transformWithStateInPandas(_InOrder(machine, columns, schema, idle_ms), machine().schema, "Append", "EventTime")


def write_once(stream: DataFrame, path: str, plan: Callable[[DataFrame], DataFrame]):
    """A writer that puts ``plan`` of each micro-batch into a folder named by the batch's number: a batch that is replayed writes the same folder again,
    so it adds no row. Returns the DataStreamWriter; the caller sets the checkpoint and starts it."""

    def put(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put)
