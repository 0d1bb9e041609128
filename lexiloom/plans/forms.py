"""Queries over word forms: the lexicon's words as roots, with the flags of a small rule file dealt by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import affixes as X
from lexiloom.operators import lookups as K
from lexiloom.plans import catalog as Q
from lexiloom.plans.catalog import _query
from lexiloom.sources import tables as S

#: A rule file for the test words: plurals, past forms and negations.
RULES = """SFX S Y 3
SFX S y ies [^aeiou]y
SFX S 0 s [^sy]
SFX S 0 es s
SFX D Y 2
SFX D 0 d e
SFX D 0 ed [^e]
PFX U Y 1
PFX U 0 un .
PFX R N 1
PFX R 0 re [^r]
"""


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lexicon, its words with flags (S by even ranks, D by every third, U by every fifth, R by every seventh), and the rules."""
    lex = S.lexicon(Q._docs(spark, sf_dir)).cache()
    flags = F.array_compact(F.array(*[F.when(F.col("rank") % n == 0, f) for f, n in (("S", 2), ("D", 3), ("U", 5), ("R", 7))]))
    lines = spark.createDataFrame([(x,) for x in RULES.splitlines()], "value string")
    return lex, lex.select("word", flags.alias("flags")), X.affix_rules(lines)


_FORMS = f"""WITH {Q._WORDS}, {Q._COUNTS}, {Q._LEX},
    s0 AS (SELECT word, 'S' AS flag, CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN left(word, -1) || 'ies' WHEN regexp_matches(word, '[^sy]$') THEN word || 's' WHEN word LIKE '%s' THEN word || 'es' END AS form FROM lex WHERE rank % 2 = 0
        UNION ALL SELECT word, 'D', CASE WHEN word LIKE '%e' THEN word || 'd' ELSE word || 'ed' END FROM lex WHERE rank % 3 = 0),
    s AS (SELECT * FROM s0 WHERE form IS NOT NULL),
    forms AS (SELECT word, word AS form, NULL AS prefix, NULL AS suffix FROM lex UNION SELECT word, form, NULL, flag FROM s UNION SELECT word, 'un' || word, 'U', NULL FROM lex WHERE rank % 5 = 0
        UNION SELECT s.word, 'un' || form, 'U', flag FROM s JOIN lex ON s.word = lex.word WHERE rank % 5 = 0 UNION SELECT word, 're' || word, 'R', NULL FROM lex WHERE rank % 7 = 0 AND word NOT LIKE 'r%')"""


@_query(_FORMS + " SELECT word, form, prefix, suffix FROM forms")
def word_forms(spark, sf_dir):
    _, entries, rules = _entries(spark, sf_dir)
    return X.word_forms(entries, rules)


@_query(_FORMS + " SELECT DISTINCT counts.word AS token, forms.word AS root, prefix, suffix FROM counts JOIN forms ON counts.word = form")
def form_analyses(spark, sf_dir):
    _, entries, rules = _entries(spark, sf_dir)
    return X.analyse(S.english_counts(Q._docs(spark, sf_dir)).select(F.col("word").alias("token")), entries, rules)


@_query(_FORMS + """, r AS (SELECT form, word AS root FROM forms WHERE form <> word QUALIFY row_number() OVER (PARTITION BY form ORDER BY (prefix IS NOT NULL)::INT + (suffix IS NOT NULL)::INT, length(word) DESC, word) = 1)
    SELECT counts.word, CASE WHEN lex.word IS NOT NULL THEN 'lexicon' WHEN r.root IS NOT NULL THEN 'form' END AS origin, round(coalesce(lex.freq, CASE WHEN r.root IS NOT NULL THEN greatest(0.68e0, least(0.90e0, b.freq * 0.82e0)) END, 0.0e0), 9)::DOUBLE AS freq
    FROM counts LEFT JOIN lex ON counts.word = lex.word LEFT JOIN r ON counts.word = r.form LEFT JOIN lex b ON r.root = b.word WHERE counts.word NOT IN (""" + Q._NAMES + ")")
def rooted_frequencies(spark, sf_dir):
    """Frequencies of all English words by the dictionary chain, whose forms come from the affix rules."""
    lex, entries, rules = _entries(spark, sf_dir)
    words = S.english_counts(Q._docs(spark, sf_dir)).filter(~F.col("word").isin(*[x.strip("' ") for x in Q._NAMES.split(",")])).select("word")
    en = F.lit("en").alias("lang")
    roots = X.root_words(words.select(F.col("word").alias("token")), entries, rules)
    none = lex.select(F.lit("").alias("word"), en, F.lit(0.0).alias("freq")).limit(0)
    found = K.dictionary_frequencies(words.select("word", en), none, lex.select("word", en, "freq"), roots.select(F.col("token").alias("word"), en, "root"))
    return found.select("word", "origin", F.round("freq", 9).alias("freq"))
