"""Global ranks of a table's rows, and a digest of the table that depends on their order but not on how they are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.shared import stored

#: Digests that one digest of the next level covers.
CHUNK = 4096
_OFFSET = 33  # of the partition in monotonically_increasing_id


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values as strings; null is told apart from every string."""
    cell = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("\x1f", *map(cell, columns)), 256)


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``rank``, from 0, in the order of ``order`` (nulls first) and, where these are equal, of the rows' digests.

    Rows are dealt by range and sorted within partitions; a partition's first rank comes from the counts of those before it, one number
    a partition. Only rows that are equal in all columns can change places."""
    key = [F.col(c) for c in order] + [F.col("_digest")]
    rows = stored(df.withColumn("_digest", row_digest(df.columns)), "rows")  # dealing by range reads the rows twice
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", _OFFSET)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    within = F.col("_id").bitwiseAND(F.lit((1 << _OFFSET) - 1))
    return rows.join(F.broadcast(counts), part == F.col("_part")).withColumn("rank", F.col("_first") + within).select(*df.columns, "rank", "_digest")


def fingerprint(df: DataFrame, order: list[str], chunk: int = CHUNK) -> DataFrame:
    """rows, digest: one row. The digests of ``chunk`` consecutive rows are joined and digested, then those digests, and so on, until one is left.

    Swapping two rows changes it, the number of partitions and files does not. An empty table has the digest of nothing."""
    level = ranked(df, order).select("rank", F.col("_digest").alias("digest"))
    n = rows = level.count()
    while True:
        item = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        joined = F.sha2(F.array_join(F.transform(item, lambda x: x["digest"]), ""), 256)
        level = level.groupBy(F.expr(f"rank div {chunk}").alias("rank")).agg(joined.alias("digest"))
        n = -(-n // chunk)
        if n <= 1:
            break
        level = stored(level, "digests")
    found = level.agg(F.max("digest").alias("digest"))
    return found.select(F.lit(rows).cast("long").alias("rows"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"))
