"""Queries over Russian orthography. French words as typed on the Russian layout stand for Russian; their letters meet all families but endings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import orthography as O
from lexiloom.plans import catalog as Q
from lexiloom.plans.catalog import _query
from lexiloom.sources import tables as S
from lexiloom.sources.shared import stored


def _french(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, freq: the French lexicon by the keys of the Russian layout."""
    lex = S.ranked_lexicon(S.ascii_counts(Q._docs(spark, sf_dir), "fr"))
    return lex.select(T.to_russian_layout(F.col("word")).alias("word"), "freq", "rank")


# one step of each family in SQL, over an expression x
_PLACES = "range(1, length({x}) + 1)"


def _replace(x: str, pairs) -> str:
    one = (f"list_transform(list_filter(range(1, length({x}) + 1), lambda i: {x}[i:i + {len(a) - 1}] = '{a}'), lambda i: left({x}, i - 1) || '{b}' || {x}[i + {len(a)}:])" for a, b in pairs)
    return f"flatten([{', '.join(one)}])"


def _doubled(x: str) -> str:
    return f"list_transform(list_filter(range(1, length({x}) + 1), lambda i: strpos('{O.OFTEN_DOUBLED}', {x}[i]) > 0 AND (i = 1 OR {x}[i - 1] <> {x}[i]) AND {x}[i + 1] <> {x}[i]), lambda i: left({x}, i) || {x}[i:])"


def _soft(x: str) -> str:
    return f"""list_concat(list_concat(CASE WHEN length({x}) >= 3 THEN [{x} || 'ь'] ELSE [] END, CASE WHEN {x} LIKE '%ь' THEN [left({x}, length({x}) - 1)] ELSE [] END),
        list_transform(list_filter(range(1, length({x}) + 1), lambda i: {x}[i:i + 1] = 'лн'), lambda i: left({x}, i) || 'ь' || {x}[i + 1:]))"""


def _cleaned(x: str) -> str:
    return f"list_transform(list_filter(range(1, length({x})), lambda i: {x}[i] = {x}[i + 1]), lambda i: left({x}, i) || {x}[i + 2:])"


def _swapped(x: str) -> str:
    return f"list_transform(list_filter(range(1, length({x})), lambda i: {x}[i] <> {x}[i + 1]), lambda i: left({x}, i - 1) || {x}[i + 1] || {x}[i] || {x}[i + 2:])"


def _structure(x: str) -> str:
    return f"flatten([{_replace(x, O.DIGRAPHS)}, {_doubled(x)}, {_soft(x)}, {_cleaned(x)}])"


def _over(values: str, step) -> str:
    return f"flatten(list_transform({values}, lambda v: {step('v')}))"


_STEPS = f"""words AS (SELECT translate(word, '{Q._EN}', '{Q._RU}') AS word FROM flex),
    one AS (SELECT word, {_replace("word", O.VOWEL_PAIRS)} AS vowel, {_structure("word")} AS structure, {_doubled("word")} AS doubled, {_cleaned("word")} AS cleaned,
        list_transform(list_filter(range(1, length(word)), lambda i: word[i] = word[i + 1]), lambda i: word[i]) AS twice FROM words),
    made AS (SELECT word, 'digraph' AS family, {_replace("word", O.DIGRAPHS)} AS m FROM one
        UNION ALL SELECT word, 'vowel', CASE WHEN length(word) >= 4 THEN list_filter(list_concat(vowel, {_over("vowel", lambda v: _replace(v, O.VOWEL_PAIRS))}), lambda y: y <> word) ELSE [] END FROM one
        UNION ALL SELECT word, 'repeated', list_concat(cleaned, flatten(list_transform(cleaned, lambda v: list_transform(twice, lambda c: v || c)))) FROM one
        UNION ALL SELECT word, 'swap', CASE WHEN length(word) > 3 THEN {_swapped("word")} ELSE [] END FROM one
        UNION ALL SELECT word, 'double_soft', {_over("doubled", _soft)} FROM one
        UNION ALL SELECT word, 'structure', list_filter(list_concat(structure, {_over("structure", _structure)}), lambda y: y <> word) FROM one)"""
_FRENCH = f"{Q._WORDS}, {Q._COUNTS.replace('counts AS', 'fcounts AS').replace(chr(39) + 'en' + chr(39), chr(39) + 'fr' + chr(39))}, {Q._LEX.replace('lex AS', 'flex AS').replace('FROM counts', 'FROM fcounts')}"


@_query(f"WITH {_FRENCH}, {_STEPS} SELECT DISTINCT word AS token, family, unnest(m) AS variant FROM made")
def orthography_variants(spark, sf_dir):
    words = _french(spark, sf_dir).select(F.col("word").alias("token"))
    return O.variants(words, ("digraph", "vowel", "repeated", "swap", "double_soft", "structure"))


@_query()
def orthography_corrections(spark, sf_dir):
    """What the families make of words with one vowel taken for another, a letter doubled, or two swapped."""
    lex = stored(_french(spark, sf_dir), "french")
    w = F.col("word")
    made = F.array_distinct(F.concat(O.vowel_changes(w), O.doubled_consonants(w), O.swaps(w)))
    return O.corrections(lex.select(F.explode(made).alias("token")).distinct(), lex)
