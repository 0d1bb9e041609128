"""The cluster's shared folder, and shipping of this package to Python workers through it."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def base_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read from there: what is used several times is computed once."""
    spark = df.sparkSession
    path = f"{base_dir(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt by columns to all partitions of a shuffle: few bytes with much work in each row would else be merged into a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(data)
    finally:
        out.close()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run."""
    sc = spark.sparkContext
    home = str(_PACKAGE.parent)
    if sc.applicationId in _shipped or home in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    path = f"{base_dir(spark)}/lexiloom-ship-{uuid.uuid4().hex}.zip"
    write_bytes(spark, path, buffer.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
