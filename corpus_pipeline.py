"""Documents to training tokens: quality rules, near-duplicates, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import neardup, workspace
from lexiloom.llm.bpe import encode_documents
from lexiloom.llm.mixing import mixed_rows
from lexiloom.llm.neardup import near_duplicates
from lexiloom.llm.privacy import find_personal_data
from lexiloom.llm.quality import quality_rules
from lexiloom.llm.queries import BPE_RANKS


# names of joined columns start with _lx_, so that documents may have columns of any other name


def _id():
    return F.col("doc_id").cast("long")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep. The verdict belongs to a doc_id and its text (and its language and source, should rows share both)."""
    verdict = quality_rules(docs).filter("kept").select(F.col("doc_id").alias("_lx_id"), F.col("text_key").alias("_lx_key")).distinct()
    key = F.xxhash64(F.col("text").cast("string"))
    return docs.join(verdict, _id().eqNullSafe(F.col("_lx_id")) & (key == F.col("_lx_key")), "left_semi")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (any one of rows that share it). Wordless texts and null ids all stay."""
    found = workspace.materialize(near_duplicates(docs).select("doc_id", "n_shingles", "kept"), "verdicts")
    gone = found.filter("not kept").select(F.col("doc_id").alias("_lx_id"), F.lit(False).alias("_lx_again")).distinct()
    again = found.filter("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    again = again.select(F.col("doc_id").alias("_lx_id"), F.lit(True).alias("_lx_again"))
    aside, seen = workspace.observed(gone.unionByName(again), "aside", F.count(F.lit(1)).alias("n"), F.count_if("_lx_again").alias("again"))
    # few ids go to where the texts lie; beyond, texts are shuffled by id once more
    sent = lambda ids: F.broadcast(ids) if seen["n"] <= neardup.BROADCAST_IDS else ids
    left = docs.join(sent(aside), _id() == F.col("_lx_id"), "left_anti")
    if not seen["again"]:
        return left
    once = docs.join(sent(aside.filter("_lx_again")), _id() == F.col("_lx_id"), "left_semi").dropDuplicates(["doc_id"])
    return left.unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with every span replaced by its kind."""
    return find_personal_data(docs, masked=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; rows that it takes no words from go."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    return encode_documents(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("byte_bpe", tokens),
]

#: Robust estimates, a trained tagger and byte-pair merges have no SQL form; tests hold the stages to plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = workspace.materialize(stage(spark, docs, sf_dir), name)
    return docs
