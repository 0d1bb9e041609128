"""Rows of tokens to rows of decisions: apply, wait or no_change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import candidates as C
from lexiloom.sources.shared import stored


def decide(tokens: DataFrame, lexicon: DataFrame, apply_at: float = 0.70, classify=C.classify_mutations) -> DataFrame:
    """token, decision, kind, replacement, reason for distinct ``tokens(token)``.

    In order: protected tokens and known words stay; a unique one-edit target that is frequent enough is applied; several
    near targets wait; tokens without a source stay.
    """
    # stored: else the texts are read for each use, and tests for protected tokens run on every occurrence
    lexicon, tokens = stored(lexicon.select("word", "freq"), "lexicon"), stored(tokens, "tokens")
    known = lexicon.select(F.col("word").alias("known"))
    low = tokens.withColumn("low", F.lower("token"))
    marked = low.join(C.sized(known), F.col("low") == F.col("known"), "left").withColumn("protected", T.is_protected(F.col("token")))
    marked = stored(marked, "marked")
    open_ = marked.filter("not protected and known is null and length(token) >= 3").select(F.col("low").alias("token")).distinct()
    found = classify(C.mutation_sources(C.one_edit_pairs(open_, lexicon, ("freq",)), lexicon))
    found = found.join(C.sized(lexicon.select(F.col("word").alias("target"), F.col("freq").alias("f"))), "target", "left")
    out = marked.join(found.withColumnRenamed("token", "low"), "low", "left")
    decision = (
        F.when(F.col("protected") | F.col("known").isNotNull() | F.col("class").isNull(), "no_change")
        .when((F.col("class") == "Unique") & (F.col("f") >= apply_at), "apply").otherwise("wait")
    )
    reason = (
        F.when(F.col("protected"), "protected").when(F.col("known").isNotNull(), "known").when(F.col("class").isNull(), "no_source")
        .when(F.col("class") == "Ambiguous", "ambiguous").when(F.col("f") >= apply_at, "unique").otherwise("rare_target")
    )
    out = out.withColumn("decision", decision)
    replacement = F.when(F.col("decision") == "apply", T.transfer_case(F.col("token"), F.col("target")))
    return out.select("token", "decision", F.when(F.col("decision") == "apply", "spelling").otherwise("none").alias("kind"), replacement.alias("replacement"), reason.alias("reason"))
