"""Pairwise rules between a winning source and its rivals, and the thresholds of each operation.

A source is a struct of word, operation, cost and freq. Rules are plain boolean expressions, so they serve in joins,
in filters and inside ``exists`` over the array of a token's sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import edits as E

EXTRA, MISSING, REPEATED = "ExtraCharacter", "MissingCharacter", "RepeatedAccidentalCharacter"
SWAP, ADJACENT, VOWEL, GENERAL = "AdjacentTransposition", "AdjacentKeySubstitution", "VowelSubstitution", "GeneralSubstitution"
# fixed values: a rival's least frequency, its cost band, a lead, a strong winner
RIVAL_FREQ, RIVAL_BAND, LEAD, STRONG = 0.70, 0.70, 0.12, 0.90


def decisive_lead(w: Column, p: Column) -> Column:
    return (w["freq"] >= STRONG) & (w["freq"] >= p["freq"] + LEAD) & (w["cost"] <= p["cost"] + 0.08)


def ultra_dominant(w: Column) -> Column:
    return (w["operation"].isin(MISSING, EXTRA) & (w["freq"] >= 0.999)) | ((w["operation"] == SWAP) & (w["freq"] >= 0.998))


def _shared_prefix(a: Column, b: Column) -> Column:
    return E.shared_prefix(a, b)


def _anagram(a: Column, b: Column) -> Column:
    return F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))


def longer_structural(w: Column, p: Column) -> Column:
    slips = ~decisive_lead(w, p) & p["operation"].isin(MISSING, SWAP, VOWEL)
    return (F.length(p["word"]) > F.length(w["word"])) & (((p["operation"] == MISSING) & (w["operation"] == ADJACENT)) | slips)


def longer_without_suffix(w: Column, p: Column) -> Column:
    kinds = ((w["operation"] == EXTRA) & p["operation"].isin(GENERAL, ADJACENT)) | ((w["operation"] == REPEATED) & (p["operation"] == ADJACENT))
    return kinds & (F.length(p["word"]) > F.length(w["word"])) & ~p["word"].endswith(w["word"])


def internal_insertion(w: Column, p: Column) -> Column:
    """The rival is the winner with letters put inside it: early, or about as frequent."""
    a, b = w["word"], p["word"]
    kinds = w["operation"].isin(EXTRA, REPEATED) & (p["operation"] == GENERAL) & (F.length(b) > F.length(a)) & ~b.startswith(a) & ~b.endswith(a)
    near = (p["freq"] + 0.02 >= w["freq"]) | (w["freq"] < STRONG)
    head = _shared_prefix(a, b)
    tail = a.substr(head + 1, F.length(a)) == F.right(b, F.length(a) - head)
    pure = tail & ((head <= 2) | near)
    one_more = ~tail & (F.length(b) == F.length(a) + 1) & ((head <= 1) | near)
    return kinds & (pure | one_more)


def swapped_peer(w: Column, p: Column) -> Column:
    delta = w["freq"] - p["freq"]
    spared = (w["freq"] >= 0.96) & (p["cost"] >= w["cost"] + 0.08) & (delta >= 0.07) & (delta < 0.10)
    general = ~spared & ((p["freq"] >= w["freq"]) | _anagram(w["word"], p["word"]) | ((w["freq"] >= 0.92) & (p["freq"] >= 0.75)))
    same = (w["operation"] == SWAP) & (w["freq"] < 0.9995) & (F.length(w["word"]) == F.length(p["word"]))
    return same & ((p["operation"] == VOWEL) | ((p["operation"] == GENERAL) & general))


def shorter_peer(w: Column, p: Column) -> Column:
    clear = (p["operation"] == GENERAL) & (w["freq"] >= p["freq"] + LEAD) & (w["freq"] >= 0.95)
    return (w["operation"] == MISSING) & ~ultra_dominant(w) & (F.length(p["word"]) == F.length(w["word"]) - 1) & p["operation"].isin(GENERAL, VOWEL, ADJACENT, SWAP) & ~clear


def suffix_extension(w: Column, p: Column) -> Column:
    longer = (F.length(p["word"]) > F.length(w["word"])) & p["word"].startswith(w["word"])
    return ~decisive_lead(w, p) & (p["operation"] == GENERAL) & w["operation"].isin(EXTRA, REPEATED) & longer


def same_length_missing(w: Column, p: Column) -> Column:
    return ~decisive_lead(w, p) & (F.length(w["word"]) == F.length(p["word"])) & (w["operation"] == MISSING) & (p["operation"] == MISSING)


def same_length_near_cost(w: Column, p: Column) -> Column:
    return ~decisive_lead(w, p) & w["operation"].isin(ADJACENT, GENERAL) & (F.length(w["word"]) == F.length(p["word"])) & ~ultra_dominant(w)


def vowel_against_general(w: Column, p: Column) -> Column:
    far = E.hamming(w["word"], p["word"])
    one = ~(((w["freq"] >= 0.95) & (w["freq"] < 0.99)) | ((w["freq"] >= 0.99) & (w["freq"] >= p["freq"] + LEAD)))
    two = (w["freq"] < 0.98) & (_shared_prefix(w["word"], p["word"]) >= F.length(w["word"]) - 3)
    return (w["operation"] == VOWEL) & (p["operation"] == GENERAL) & (F.length(w["word"]) == F.length(p["word"])) & (((far == 1) & one) | ((far == 2) & two))


def vowel_against_vowel(w: Column, p: Column) -> Column:
    return (w["operation"] == VOWEL) & (p["operation"] == VOWEL) & (F.length(w["word"]) == F.length(p["word"])) & (w["word"] != p["word"])


PEERS = {
    f.__name__: f
    for f in (
        longer_structural, longer_without_suffix, internal_insertion, swapped_peer, shorter_peer, suffix_extension, same_length_missing, same_length_near_cost,
        vowel_against_general, vowel_against_vowel,
    )
}


def competes(w: Column, p: Column) -> Column:
    """Frequent and cheap enough to be a rival at all."""
    return (p["word"] != w["word"]) & (p["freq"] >= RIVAL_FREQ) & (p["cost"] <= w["cost"] + RIVAL_BAND)


def has_rival(w: Column, sources: Column) -> Column:
    """Whether a rule finds a rival of w among an array of sources."""

    def beaten(p: Column) -> Column:
        found = F.lit(False)
        for rule in PEERS.values():
            found = found | rule(w, p)
        return competes(w, p) & found

    return F.exists(sources, beaten)


def rival_rules(sources: DataFrame, winners: DataFrame) -> DataFrame:
    """token, rule, n: how many rivals of a token's winner each rule finds. winners(token, target). An equi-join on the token; its
    sources are bounded by one-edit neighbours."""
    s = F.struct("word", "operation", "cost", "freq")
    w = sources.join(winners.select("token", F.col("target").alias("word")), ["token", "word"]).select("token", s.alias("w"))
    pairs = w.join(sources.select(F.col("token"), s.alias("p")), "token").filter(competes(F.col("w"), F.col("p")))
    hits = F.filter(F.array(*[F.when(f(F.col("w"), F.col("p")), F.lit(n)) for n, f in PEERS.items()]), lambda x: x.isNotNull())
    return pairs.select("token", F.explode(hits).alias("rule")).groupBy("token", "rule").agg(F.count(F.lit(1)).alias("n"))


def passes_precision(w: Column) -> Column:
    """Thresholds by operation: inserted and missing letters need a frequent word, swaps none, others 0.65."""
    return F.when(w["operation"].isin(EXTRA, MISSING), w["freq"] >= 0.70).when(w["operation"] == SWAP, True).otherwise(w["freq"] >= 0.65)


def guarded_decisions(sources: DataFrame, winners: DataFrame) -> DataFrame:
    """token, target, decision: apply where the winner passes its threshold and no rule finds a rival (a nearly certain swap needs none), else wait."""
    s = F.struct("word", "operation", "cost", "freq")
    w = sources.join(winners.select("token", F.col("target").alias("word")), ["token", "word"]).select("token", F.col("word").alias("target"), s.alias("w"))
    rivals = rival_rules(sources, winners).groupBy("token").agg(F.count(F.lit(1)).alias("rules"))
    free = (F.col("w.operation") == SWAP) & (F.col("w.freq") >= 0.9995)
    fine = passes_precision(F.col("w")) & (F.col("rules").isNull() | free)
    return w.join(rivals, "token", "left").select("token", "target", F.when(fine, "apply").otherwise("wait").alias("decision"))


# fixed values: confidence and margin of an outside scorer, frequency of its spelling targets
SCORER_CONFIDENCE, SCORER_MARGIN, SCORER_FREQ = 0.98, 0.20, 0.70


def promotes_scorer(token: Column, word: Column, core: Column, kind: Column, confidence: Column, margin: Column, freq: Column, layout_on: Column, spelling_on: Column) -> Column:
    """Whether an outside scorer's word replaces the token: only where the own decision is to wait, for another single word, with a sure
    confidence and margin, a kind that is switched on, and for a spelling, a frequent word. Unknown values never promote."""
    one = word.rlike(r"^\S+$") & (F.lower(word) != F.lower(token))
    sure = (confidence >= SCORER_CONFIDENCE) & (margin >= SCORER_MARGIN) & ~F.isnan(confidence) & ~F.isnan(margin) & (confidence < float("inf")) & (margin < float("inf"))
    allowed = F.when(kind == "layout", layout_on).when(kind == "spelling", spelling_on & (freq >= SCORER_FREQ)).otherwise(False)
    return F.coalesce((core == "wait") & one & sure & allowed, F.lit(False))
