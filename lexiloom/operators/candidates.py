"""Similarity joins of tokens with a lexicon, and decisions over the candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import edits as E
from lexiloom.sources.shared import spread

#: Words up to which a lexicon is sent to all executors.
BROADCAST_WORDS = 500_000


def sized(table: DataFrame, rows: int = BROADCAST_WORDS) -> DataFrame:
    """The table, marked for broadcast if it has at most ``rows`` rows."""
    few = table.limit(rows + 1).count() <= rows
    return F.broadcast(table) if few else table


def merged(table: DataFrame) -> DataFrame:
    """The table, marked for a sort-merge join, which needs no room on the driver. Spark takes the size of a Parquet file for that of the rows
    made from it: some MB of words, exploded to their keys, would be broadcast, and a broadcast once planned is not taken back."""
    return table.hint("merge")


def one_edit_pairs(tokens: DataFrame, lexicon: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """token, word: lexicon words one edit from a token, by deletion keys: both sides meet on the string with one
    character less (or their own form). Meetings are verified where they happen, so that only true pairs are shuffled again.
    tokens(token) must be distinct; columns ``keep`` of the lexicon, one row a word, go along with the pairs."""
    keys = lambda df, c, *more: df.select(c, *more, F.explode(F.array_distinct(F.concat(F.array(F.col(c)), E.deletions(F.col(c))))).alias("key"))
    met = keys(spread(tokens.select("token"), "token"), "token").join(merged(keys(spread(lexicon.select("word", *keep), "word"), "word", *keep)), "key").filter("token != word")
    near = (F.levenshtein("token", "word", 1) == 1) | E.is_transposition(F.col("token"), F.col("word"))
    return met.filter(near).select("token", "word", *keep).distinct()


def generated_pairs(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The same pairs by generating each token's neighbours: the cheaper way for short token lists."""
    near = tokens.select("token", F.explode(E.one_edit_neighbours(F.col("token"))).alias("word"))
    return near.join(sized(lexicon.select("word")), "word").filter("token != word").select("token", "word")


def mutation_sources(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """token, word, operation, cost, freq of each pair whose slip has a name. Pairs that bring freq along meet the lexicon no more."""
    kind = E.classify_edit(F.col("token"), F.col("word"))
    out = pairs.withColumn("operation", kind).filter("operation != 'Unknown'").withColumn("cost", E.edit_cost(F.col("operation")))
    out = out if "freq" in pairs.columns else out.join(sized(lexicon.select("word", "freq")), "word")
    return out.select("token", "word", "operation", "cost", "freq")


def clear_winner(champion: Column, challenger: Column) -> Column:
    """The full dominance test of two sources (word, cost, freq, operation), as surveyed: the first rule that fits decides."""
    a, b = champion, challenger
    length = lambda s: s["operation"].isin("MissingCharacter", "ExtraCharacter") & (s["freq"] >= 0.999)
    beside = lambda s: s["operation"] == "AdjacentKeySubstitution"
    far_ahead = lambda x, y: (x["freq"] >= 0.995) & (x["freq"] >= y["freq"] + 0.004)
    cheaper = F.when(a["cost"] + 0.01 < b["cost"], a["operation"]).when(b["cost"] + 0.01 < a["cost"], b["operation"])
    judged = F.when(a["operation"] == b["operation"], a["operation"]).otherwise(F.coalesce(cheaper, F.when(a["freq"] >= b["freq"], a["operation"]).otherwise(b["operation"])))
    return (
        F.when(length(a) & beside(b) & (a["freq"] + 0.0001 >= b["freq"]), True)
        .when(length(b) & beside(a) & (b["freq"] + 0.0001 >= a["freq"]), False)
        .when(a["cost"] + 0.01 < b["cost"], ~far_ahead(b, a))
        .when(a["cost"] > b["cost"] + 0.08, far_ahead(a, b))
        .when(
            judged.isin("VowelSubstitution", "GeneralSubstitution", "AdjacentKeySubstitution"),
            ((a["freq"] >= 0.995) & (b["freq"] <= a["freq"] - 0.004)) | ((a["freq"] >= 0.90) & (a["freq"] >= b["freq"] + 0.12)),
        )
        .otherwise((a["freq"] >= b["freq"] + 0.12) | (a["freq"] >= 0.995))
    )


def apply_bands(sources: DataFrame) -> DataFrame:
    """The sources with in_band: in the credible band (cost up to 0.35 above the token's least, freq from 0.50), or in the minimum band
    (up to 0.08 above, and up to 0.20 for words of freq from 0.995)."""
    over = lambda by: F.col("cost") <= F.min("cost").over(Window.partitionBy("token")) + by
    return sources.withColumn("in_band", (over(0.35) & (F.col("freq") >= 0.50)) | over(0.08) | (over(0.20) & (F.col("freq") >= 0.995)))


def _unbeaten(band: str) -> Column:
    return F.filter(band, lambda s: ~F.exists(band, lambda o: (o["word"] != s["word"]) & clear_winner(o, s)))


def classify_mutations(sources: DataFrame, keep: bool = False) -> DataFrame:
    """token, n_sources, n_band, class, target: the target is the one source of a token's apply band that no other beats, if it beats
    every other. The array of a token is bounded by its one-edit neighbours. ``keep`` adds all its sources as an array."""
    kept = F.collect_list(F.when(F.col("in_band"), F.struct("word", "cost", "freq", "operation")))
    found = apply_bands(sources).groupBy("token").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if("in_band").alias("n_band"), kept.alias("band"), *([F.collect_list(F.struct("word", "operation", "cost", "freq")).alias("sources")] if keep else []))
    found = found.withColumn("unbeaten", _unbeaten("band")).withColumn("best", F.get("unbeaten", F.lit(0)))
    unique = (F.size("unbeaten") == 1) & F.forall("band", lambda s: (s["word"] == F.col("best.word")) | clear_winner(F.col("best"), s))
    return found.select("token", "n_sources", "n_band", F.when(unique, "Unique").otherwise("Ambiguous").alias("class"), F.when(unique, F.col("best.word")).alias("target"), *(["sources"] if keep else []))


def skyline(sources: DataFrame) -> DataFrame:
    """token, word of the sources of each token's apply band that no other one there beats by the full dominance test."""
    band = apply_bands(sources).filter("in_band").groupBy("token").agg(F.collect_list(F.struct("word", "cost", "freq", "operation")).alias("band"))
    return band.select("token", F.explode(_unbeaten("band")).alias("s")).select("token", "s.word")


def top_candidates(sources: DataFrame, k: int) -> DataFrame:
    """The k cheapest sources of each token: cost, then frequency down, then word."""
    order = Window.partitionBy("token").orderBy("cost", F.desc("freq"), "word")
    return sources.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def longest_word(lexicon: DataFrame) -> int:
    """Letters of the longest word: no limit is set on the length of words that are looked up."""
    return lexicon.agg(F.coalesce(F.max(F.length("word")), F.lit(1))).first()[0]


def dictionary_prefixes(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """token, word: every lexicon word that a token starts with."""
    lengths = F.sequence(F.lit(1), F.least(F.length("token"), F.lit(longest_word(lexicon))))
    cut = tokens.filter("token != ''").select("token", F.explode(F.transform(lengths, lambda n: F.col("token").substr(F.lit(1), n))).alias("word"))
    return cut.join(sized(lexicon.select("word")), "word").select("token", "word")


def dictionary_substrings(tokens: DataFrame, lexicon: DataFrame, backward: bool = False) -> DataFrame:
    """token, start, word: every lexicon word at every place of a token; places count from the end, and words are read
    backward, if ``backward``. Repeated words give repeated rows."""
    longest = longest_word(lexicon)
    read = F.reverse("token") if backward else F.col("token")
    t = tokens.filter("token != ''").select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("start"), read.alias("read"))
    ends = F.sequence(F.lit(1), F.least(F.length("read") - F.col("start") + 1, F.lit(longest)))
    cut = t.select("token", "start", F.explode(F.transform(ends, lambda n: F.col("read").substr(F.col("start"), n))).alias("word"))
    return cut.join(sized(lexicon.select("word")), "word").select("token", "start", "word")
