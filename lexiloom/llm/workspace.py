"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from lexiloom.sources.shared import base_dir, ship, write_bytes

__all__ = ["base_dir", "drop", "materialize", "new_path", "observed", "read_bytes", "ship", "write_bytes"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{base_dir(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and
    survives lost executors. Columns come back nullable, in the same order."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates over the rows (by alias) that are taken while they are written, without a query of their own."""
    seen = Observation()
    table = materialize(df.observe(seen, *metrics), name)
    return table, seen.get


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file of the shared folder; None if it is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def drop(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lexiloom-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
