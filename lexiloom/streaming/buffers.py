"""Input buffers that are folds over a key's events: snippet triggers, recent text, and rejected corrections.

A buffer is written once, as a small state machine, and runs in two ways: over a table, where sorted partitions pass
through it in batches (memory does not grow with a key's events), and over a stream, where its state is kept per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiloom.functions import text as T
from lexiloom.sources.shared import ship


class TriggerBuffer:
    """Printable characters up to a boundary, which takes them as a trigger. Blanks, control characters, resets and one
    character too many clear it."""

    schema, state_schema = "key long, event_id long, trigger string", "text string"

    def __init__(self, longest: int = 64):
        self.longest, self.text = longest, ""

    def load(self, state: tuple) -> None:
        (self.text,) = state

    def save(self) -> tuple:
        return (self.text,)

    def step(self, e) -> tuple | None:
        out = None
        if e.kind == "Boundary":
            out = (e.key, e.event_id, self.text) if self.text else None
            self.text = ""
        elif e.kind == "Backspace":
            self.text = self.text[:-1]
        elif e.kind == "Character" and e.ch.isprintable() and not e.ch.isspace() and len(self.text) < self.longest:
            self.text += e.ch
        else:
            self.text = ""
        return out


class TextContext:
    """The last characters that were typed, with a number that every change raises; reported at boundaries, which type a blank."""

    schema, state_schema = "key long, event_id long, context string, version long", "text string, version long"

    def __init__(self, longest: int = 512):
        self.longest, self.text, self.version = longest, "", 0

    def load(self, state: tuple) -> None:
        self.text, self.version = state

    def save(self) -> tuple:
        return self.text, self.version

    def step(self, e) -> tuple | None:
        if e.kind == "Backspace":
            self.version += bool(self.text)
            self.text = self.text[:-1]
            return None
        ch = " " if e.kind == "Boundary" else e.ch
        keep = e.kind == "Boundary" or (e.kind == "Character" and (ch >= " " or ch == "\t") and not "\x7f" <= ch <= "\x9f")
        self.text = (self.text + ch)[-self.longest :] if keep else ""
        self.version += 1
        return (e.key, e.event_id, self.text, self.version) if e.kind == "Boundary" else None


class RejectionTracker:
    """A correction is rejected when its replacement is erased and the original typed again at once, within the time to live.
    Anything else ends the watch; a new correction replaces it. Originals and replacements of one letter are not watched."""

    schema = "key long, event_id long, correction_id long, candidate string, replacement string"
    state_schema = "correction_id long, began long, original string, replacement string, erased long, typed string"
    _nothing = (None, 0, "", "", 0, "")

    def __init__(self, ttl_ms: int = 30_000):
        self.ttl = ttl_ms
        self.load(self._nothing)

    def load(self, state: tuple) -> None:
        self.correction, self.began, self.original, self.replacement, self.erased, self.typed = state

    def save(self) -> tuple:
        return self.correction, self.began, self.original, self.replacement, self.erased, self.typed

    def step(self, e) -> tuple | None:
        if e.kind == "Correction":
            if e.watched:
                self.load((e.event_id, e.ms, e.original, e.replacement, 0, ""))
            return None
        if self.correction is None:
            return None
        erasing = self.erased < len(self.replacement)
        if e.ms < self.began + self.ttl:
            if erasing and e.kind == "Backspace":
                self.erased += 1
                return None
            if not erasing and e.kind == "Character" and self.original.startswith(self.typed + e.ch):
                self.typed += e.ch
                if self.typed != self.original:
                    return None
                out = (e.key, e.event_id, self.correction, self.original, self.replacement)
                self.load(self._nothing)
                return out
        self.load(self._nothing)
        return None


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def over_table(inputs: DataFrame, buffer: type, **options) -> DataFrame:
    """What the buffer reports over ``inputs(event_id, ts, key, kind, ch)``, in the order of ts and event_id of each key."""
    names = _names(buffer.schema)
    ship(inputs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, buffer(**options)
        for frame in frames:
            out = []
            for e in frame.itertuples(index=False):
                if e.key != key:
                    key, machine = e.key, buffer(**options)
                if (row := machine.step(e)) is not None:
                    out.append(row)
            yield pd.DataFrame(out, columns=names)

    rows = inputs.filter("key is not null").repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return rows.mapInPandas(run, buffer.schema)


def over_stream(inputs: DataFrame, buffer: type, **options) -> DataFrame:
    """The same over a stream; events of a key must arrive in order of their micro-batches."""
    names = _names(buffer.schema)
    ship(inputs.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = buffer(**options)
        if state.exists:
            machine.load(state.get)
        events = pd.concat(list(frames)).sort_values(["ts", "event_id"])  # one key's part of a micro-batch
        out = [row for e in events.itertuples(index=False) if (row := machine.step(e)) is not None]
        state.update(machine.save())
        yield pd.DataFrame(out, columns=names)

    return inputs.filter("key is not null").groupBy("key").applyInPandasWithState(run, buffer.schema, buffer.state_schema, "append", GroupStateTimeout.NoTimeout)


def watched(inputs: DataFrame) -> DataFrame:
    """Input rows for RejectionTracker from ``inputs(event_id, ts, key, kind, ch, original, replacement)``."""
    plain = lambda c: (F.length(c) > 1) & ~T.is_protected(F.col(c))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return inputs.withColumn("ms", ms).withColumn("watched", F.coalesce(plain("original") & plain("replacement"), F.lit(False)))
