"""Streams whose events come out of order, expire, or are replayed, against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import sessions as N
from lexiloom.streaming import buffers as B
from lexiloom.streaming import ordered as O

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, key long, kind string, ch string"


def events(n=240, seed=2):
    rng = random.Random(seed)
    out, clock = [], {k: 0.0 for k in range(4)}
    for i in range(n):
        k = rng.randrange(4)
        clock[k] += rng.choice([0.5, 5, 29, 31, 45])
        out.append((i, START + dt.timedelta(seconds=clock[k]), k, rng.choice(["Correction", "Correction", "Undo", "Character", "Boundary"]), rng.choice("abc")))
    return out


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, O.STATE_STORE)
    yield spark
    spark.conf.set(key, old) if old else spark.conf.unset(key)


def run(spark, folder, batches, machine, **options):
    """The rows of a stream that gets one file a micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = O.in_order(stream, machine, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in spark.read.schema(machine().schema).parquet(f"{folder}/out").collect()), q


LATER = (10**6, START + dt.timedelta(days=3), 99, "Character", "x")


def test_shuffled_stream_equals_table(store, tmp_path):
    rows = events()
    table = store.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in N.undone(table, 30_000).collect())
    mixed = sorted(rows, key=lambda r: r[1])
    rng = random.Random(1)
    rng.shuffle(mixed)
    got, q = run(store, tmp_path, [mixed[:80], mixed[80:170], mixed[170:], [LATER]], O.UndoWindow, delay="2 days", idle_ms=60_000)
    assert want and sorted(r[1:] for r in got) == want
    twin = sorted(tuple(r) for r in B.over_table(O.with_micros(table), O.UndoWindow).collect())
    assert got == twin


def test_state_expires(store, tmp_path):
    """With a moving clock: an undo after the time to live finds nothing, and quiet keys leave no state."""
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [[(1, at(0), 1, "Correction", "a"), (2, at(1), 2, "Correction", "a")], [(3, at(20), 1, "Undo", "a")], [(4, at(5000), 2, "Undo", "a")], [LATER], [(LATER[0] + 1, LATER[1] + dt.timedelta(days=1), 99, "Character", "x")]]
    got, q = run(store, tmp_path, batches, O.UndoWindow, delay="0 seconds", idle_ms=60_000)
    assert got == [(1, 1, 3, 20_000.0)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # the last key alone is still there


def test_replayed_batches_add_nothing(spark, tmp_path):
    rows = spark.createDataFrame(events(40), SCHEMA)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    plan = lambda df: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    for checkpoint in ("a", "b"):  # a lost checkpoint starts from batch 0 again
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = O.write_once(stream, f"{tmp_path}/out", plan).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = spark.read.parquet(f"{tmp_path}/out")
        assert sorted((r["kind"], r["n"]) for r in got.collect()) == sorted((r["kind"], r["n"]) for r in plan(rows).collect())
