"""Two-edit candidates, their scores, and the choice between competing options of a token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import edits as E
from lexiloom.operators import candidates as C
from lexiloom.sources.shared import spread, stored

FARTHEST = 2


def near_distance(a: Column, b: Column) -> Column:
    """Edits with swaps of neighbours between a and b; exact up to two, larger beyond."""
    after = lambda x, y: F.array_min(F.transform(E.transpositions(x), lambda t: F.levenshtein(t, y))) + 1
    both = F.when(F.arrays_overlap(E.transpositions(a), E.transpositions(b)), F.lit(2))
    return F.least(F.levenshtein(a, b), after(a, b), after(b, a), both)


def two_edit_candidates(tokens: DataFrame, lexicon: DataFrame, k: int = 16) -> DataFrame:
    """token, word, freq, distance, n, rank: the nearest words of each token within two edits, n of them, and the k most
    frequent of these. tokens(token) must be distinct; lexicon(word, freq). Tokens with a word one edit away need no farther ones. The others meet
    words on what is left of both after up to two deletions, two on one side at least: what is left after one deletion of both is still the same
    after another. Meetings are verified where they happen, the costly test for swaps only where plain edits leave it open."""
    tokens, lexicon = stored(tokens.select("token"), "tokens"), stored(lexicon.select("word", "freq"), "lexicon")
    near = stored(C.one_edit_pairs(tokens, lexicon, ("freq",)), "near")
    rest = tokens.join(C.merged(near.select("token").distinct()), "token", "left_anti")

    def keys(df: DataFrame, c: str) -> DataFrame:
        once = F.array_distinct(E.deletions(F.col(c)))
        left = (F.array(F.col(c)), once, F.array_distinct(F.flatten(F.transform(once, E.deletions))))
        marked = lambda values, d: F.transform(values, lambda v: F.struct(F.lit(d).alias("d"), v.alias("key")))
        made = [marked(x, d) for d, x in enumerate(left)]
        return df.select("*", F.explode(F.concat(*made)).alias("s")).select(*df.columns, F.col("s.d").alias(f"{c}_d"), F.col("s.key").alias("key"))

    met = keys(spread(rest, "token"), "token").join(C.merged(keys(spread(lexicon, "word"), "word")), "key").filter((F.greatest("token_d", "word_d") == FARTHEST) & (F.col("token") != F.col("word")))
    met = met.select("token", "word", "freq", F.levenshtein("token", "word", 2 * FARTHEST).alias("plain"))
    # two swaps keep all letters, and are four plain edits; one swap and an edit are three
    letters = lambda c: F.array_sort(F.split(c, ""))
    swaps = (F.col("plain") == 3) | ((F.col("plain") == 4) & (F.length("token") == F.length("word")) & (letters("token") == letters("word")))
    met = met.filter((F.col("plain") == FARTHEST) | swaps).distinct()
    far = met.filter((F.col("plain") == FARTHEST) | (near_distance(F.col("token"), F.col("word")) == FARTHEST))
    found = near.withColumn("distance", F.lit(1).cast("long")).unionByName(far.select("token", "word", "freq", F.lit(FARTHEST).cast("long").alias("distance")))
    one = Window.partitionBy("token")
    found = found.withColumn("n", F.count(F.lit(1)).over(one)).withColumn("rank", F.row_number().over(one.orderBy(F.desc("freq"), "word")).cast("long"))
    return found.filter(F.col("rank") <= k)


def external_score(distance: Column, freq: Column, n: Column, soft_sign: Column | None = None) -> Column:
    """Score of a candidate of an outside provider: frequency helps, distance and company hurt."""
    soft = F.lit(0.0) if soft_sign is None else F.when(soft_sign, 0.04).otherwise(0.0)
    return 0.76 + 0.12 * freq - F.when(n > 1, 0.08).otherwise(0.0) - 0.10 * (distance - 1) + soft


#: Of options with one score, the kind that goes first.
KIND_ORDER = ("combined", "spelling", "layout")


def joint_decisions(options: DataFrame, apply_at: float = 0.70, wait_at: float = 0.45, gap: float = 0.05) -> DataFrame:
    """token, kind, word, decision from ``options(token, kind, word, score)``: the best option of a token is applied if it is good
    enough and no other option that could be waited for is within the gap; ties by KIND_ORDER, then the word."""
    order = Window.partitionBy("token").orderBy(F.desc("score"), F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind")), "word")
    ranked = options.withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).filter("k = 1")
    rivalled = (F.col("second") >= wait_at) & (F.round(F.col("score") - F.col("second"), 9) <= gap)
    decision = F.when(rivalled, "wait").when(F.col("score") >= apply_at, "apply").when(F.col("score") >= wait_at, "wait").otherwise("no_change")
    return ranked.select("token", "kind", "word", decision.alias("decision"))


# fixed values: score added for an entry of the user, for a known Russian form
USER_BOOST, FORM_BOOST = 0.14, 0.06


def candidate_score(token: Column, word: Column, cost: Column, freq: Column, p_token: Column, p_word: Column, adjacent: Column, trusted: Column, blocked: Column, boost: Column) -> Column:
    """Score from 0 to 0.95 of a known word for a token, by edit cost, plausibility of both, and frequency.

    adjacent says whether a neighbouring key was used, trusted whether the token is a trusted word, blocked whether one known word may not
    become another; boost is what the dictionary of the word adds. One letter less, unless it was doubled, needs a frequency of 0.93 and five letters."""
    n, m = F.length(token), F.length(word)
    gain = F.round(p_word - p_token, 9)
    shorter = F.when(n > m, F.array_contains(E.deletions(token), word)).otherwise(F.array_contains(E.deletions(word), token))
    single = F.when(n == m, E.hamming(token, word).between(1, 2)).when(F.abs(n - m) == 1, shorter).otherwise(False)
    gain = F.when(gain > 0.01, gain).when(~trusted & (cost <= 1.0) & single, 0.10)
    edit = F.greatest(F.lit(0.20), 1 - cost * 0.50)
    edit = F.when(adjacent, F.least(F.lit(1.0), edit + 0.06)).otherwise(edit)
    often = F.when(freq > 0, F.least(F.lit(0.22), freq * 0.22)).otherwise(0.03)
    cheap = cost <= 0.76
    plus = lambda value, case: F.when(case, value).otherwise(0.0)
    score = 0.22 * edit + 0.26 * p_word + 0.26 * F.least(F.lit(0.55), gain) + often
    score = score + plus(0.14, ~trusted) + plus(0.05, gain >= 0.18) + plus(0.06, cheap & (n == m) & single) + plus(0.04, cheap & (freq >= 0.90))
    score = score + plus(0.07, cheap & E.is_transposition(token, word)) + plus(0.10, F.array_contains(E.repeat_cleanups(word), token))
    undoubled, removed = F.array_contains(E.repeat_cleanups(token), word), m == n - 1
    score = F.when(undoubled, score + 0.22 + plus(0.06, freq >= 0.70)).when(removed, score * 0.78).otherwise(score)
    lost = blocked | gain.isNull() | (removed & ~undoubled & ((freq < 0.93) | (n <= 4)))
    length = F.when(n <= 1, 0.0).when(n == 2, 0.60).when(n == 3, 0.88).otherwise(1.0)
    return F.when(lost, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.95), (score + boost) * length)))


def best_candidates(scored: DataFrame) -> DataFrame:
    """token, word, score, n of ``scored(token, word, score, tier, freq, cost)``: the best candidate of a score above 0, ties by the higher tier, the higher
    frequency, the lower cost, the smaller word; n counts those above 0."""
    best = F.min(F.struct((-F.round("score", 9)).alias("s"), (-F.col("tier")).alias("t"), (-F.col("freq")).alias("f"), F.col("cost").alias("c"), F.col("word").alias("w")))
    found = scored.filter("score > 0").groupBy("token").agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
    return found.select("token", F.col("b.w").alias("word"), (-F.col("b.s")).alias("score"), "n")
