"""Queries over the decision tables of layout, spelling and combined corrections. French words as typed on the Russian layout stand for Russian."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import candidates as C
from lexiloom.operators import guards as D
from lexiloom.operators import lookups as K
from lexiloom.plans import catalog as Q
from lexiloom.plans.catalog import _query
from lexiloom.sources import tables as S
from lexiloom.sources.shared import stored


def two_dictionaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """word, lang, freq, never, user of both languages (every 97th word is never corrected, every 89th the user's), both ranked lexicons, and the
    English words that are too rare for one. The texts are read once."""
    counts = stored(S.counts_by_language(Q._docs(spark, sf_dir), ("en", "fr")), "counts")
    of = lambda lang: counts.filter(F.col("lang") == lang).select("word", "n")
    english, french = (stored(S.ranked_lexicon(of(lang)), "lexicon") for lang in ("en", "fr"))
    entry = lambda df, lang, word: df.select(word.alias("word"), F.lit(lang).alias("lang"), "freq", (F.col("rank") % 97 == 0).alias("never"), (F.col("rank") % 89 == 0).alias("user"))
    both = entry(english, "en", F.col("word")).unionByName(entry(french, "ru", T.to_russian_layout(F.col("word"))))
    return both, english, french, of("en").filter("n < 5")


def _hinted(df: DataFrame, token, replacement, lang: str, ru=None, en=None, some=None) -> DataFrame:
    no = F.lit(False)
    return df.select(token.alias("token"), replacement.alias("replacement"), F.lit(lang).alias("lang"), *[(no if x is None else x).alias(n) for x, n in ((ru, "strong_ru"), (en, "strong_en"), (some, "some_en"))])


def _p(x: str, vowels: str, consonants: str) -> str:
    """SQL for the plausibility of lower-case x."""
    v = f"length(regexp_replace({x}, '[^{vowels}]', '', 'g'))"
    run = f"list_max(list_transform(regexp_split_to_array(regexp_replace({x}, '[^{vowels}{consonants}]', '', 'g'), '[{vowels}]'), lambda r: length(r)))"
    return f"""CASE WHEN length({x}) = 1 THEN CASE WHEN {v} = 1 THEN 0.45e0 ELSE 0.25e0 END WHEN {v} = 0 THEN 0.12e0 ELSE greatest(0.0e0, least(1.0e0, 0.72e0 + CASE WHEN length({x}) >= 3 THEN 0.08e0 ELSE 0 END
        + CASE WHEN length({x}) >= 5 THEN 0.05e0 ELSE 0 END + CASE WHEN {v} / length({x}) BETWEEN 0.25e0 AND 0.60e0 THEN 0.05e0 WHEN {v} / length({x}) < 0.25e0 THEN -0.16e0 ELSE 0 END
        + CASE WHEN {run} > 3 THEN -0.22e0 WHEN {run} = 3 THEN -0.10e0 ELSE 0 END)) END::DOUBLE"""


_P_EN, _P_RU = (lambda x: _p(x, "aeiouy", "bcdfghjklmnpqrstvwxz")), (lambda x: _p(x, "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"))
_DICT = f"""{Q._WORDS}, {Q._COUNTS}, {Q._LEX}, {Q._COUNTS.replace("counts AS", "fcounts AS").replace("'en'", "'fr'")}, {Q._LEX.replace("lex AS", "flex AS").replace("FROM counts", "FROM fcounts")},
    dict AS (SELECT word AS key, 'en' AS lang, freq, rank % 97 = 0 AS never, rank % 89 = 0 AS usr FROM lex UNION ALL SELECT translate(word, '{Q._EN}', '{Q._RU}'), 'ru', freq, rank % 97 = 0, rank % 89 = 0 FROM flex)"""
_CUTS = "unnest(list_distinct(list_concat([{0}], list_transform(range(1, length({0}) + 1), lambda i: left({0}, i - 1) || {0}[i + 1:])))) AS cut"
# neighbours meet on what one deletion leaves of them; distances of the engine count bytes, so letters are compared
_ONE_EDIT = """CASE WHEN length(token) = length(word) THEN len(list_filter(range(1, length(token) + 1), lambda i: token[i] <> word[i])) = 1
        OR len(list_filter(range(1, length(token)), lambda i: left(token, i - 1) || token[i + 1] || token[i] || token[i + 2:] = word AND token[i] <> token[i + 1])) > 0 ELSE length(cut) = least(length(token), length(word)) END"""
_NEAR = f"""near AS (SELECT DISTINCT token, word, freq, n FROM (SELECT token, {_CUTS.format("token")} FROM rare) JOIN (SELECT word, freq, n, {_CUTS.format("word")} FROM long) USING (cut)
        WHERE token <> word AND {_ONE_EDIT})"""
# class, target, sources, rival and safety of the tokens of tk(token, lang)
_ANALYSIS = f"""rare AS (SELECT DISTINCT token FROM tk LEFT JOIN dict d ON token = d.key AND tk.lang = d.lang WHERE d.key IS NULL AND token NOT IN ({Q._NAMES})), long AS (SELECT key AS word, freq, 0 AS n FROM dict WHERE NOT never),
    {_NEAR}, {Q._KIND}, {Q._RIVALS.removeprefix(Q._BASE + ", ")},
    ana AS (SELECT tk.token, tk.lang, CASE WHEN tk.token IN ({Q._NAMES}) THEN 'Protected' WHEN d.key IS NOT NULL THEN 'KnownWord' WHEN u.target IS NOT NULL THEN 'Unique' ELSE 'Ambiguous' END AS class,
            CASE WHEN rare.token IS NOT NULL THEN u.target END AS target, CASE WHEN rare.token IS NOT NULL THEN coalesce(z.n, 0) ELSE 0 END AS n_sources, rare.token IS NOT NULL AND tk.token IN (SELECT token FROM hit) AS rival,
            coalesce(CASE WHEN win.wo IN ('ExtraCharacter', 'MissingCharacter') THEN win.wf >= 0.70e0 WHEN win.wo = 'AdjacentTransposition' THEN TRUE ELSE win.wf >= 0.65e0 END, FALSE) AS safe
        FROM tk LEFT JOIN dict d ON tk.token = d.key AND tk.lang = d.lang LEFT JOIN rare ON tk.token = rare.token LEFT JOIN uniq u ON tk.token = u.token LEFT JOIN win ON tk.token = win.token
        LEFT JOIN (SELECT token, count(*) AS n FROM src GROUP BY 1) z ON tk.token = z.token)"""
_AUTONOMOUS, _ANCHORS, _TECHNICAL = (", ".join(f"'{x}'" for x in v) for v in (D.AUTONOMOUS, K.LAYOUT_ANCHORS, K.TECHNICAL_WORDS))
_SERVICE = f"svc(low, word, target) AS (VALUES {Q._SERVICE})"
_LAYOUT_PROPOSALS = f"""prop AS (SELECT word AS token, translate(word, '{Q._EN}', '{Q._RU}') AS replacement, 'en' AS lang, rank % 3 = 0 AS sr, FALSE AS se, FALSE AS sm FROM flex
        UNION ALL SELECT translate(word, '{Q._EN}', '{Q._RU}'), word, 'ru', FALSE, rank % 3 = 1, rank % 3 = 2 FROM lex
        UNION ALL SELECT word, translate(word, '{Q._EN}', '{Q._RU}'), 'en', FALSE, FALSE, FALSE FROM counts WHERE n < 5
        UNION ALL SELECT translate(word, '{Q._EN}', '{Q._RU}'), word, 'ru', FALSE, FALSE, FALSE FROM counts WHERE n < 5)"""
_LAYOUT_VERDICTS = f"""facts AS (
    SELECT p.*, CASE p.lang WHEN 'en' THEN 'ru' ELSE 'en' END AS other, o.key IS NOT NULL AS known, coalesce(o.freq, 0) AS ofreq, coalesce(o.never, FALSE) AS onever, coalesce(o.usr, FALSE) AS ouser,
        n.key IS NOT NULL AS has, coalesce(n.freq, 0) AS f, coalesce(n.never, FALSE) AS nnever, x.key IS NOT NULL AS crossed, s.word AS sword, s.target AS starget, a.class, a.target, a.n_sources, a.rival,
        length(p.token) AS l, p.token IN ({_ANCHORS}) AS anchor, CASE p.lang WHEN 'en' THEN {_P_EN("p.token")} ELSE {_P_RU("p.token")} END AS pt, CASE p.lang WHEN 'en' THEN {_P_RU("p.replacement")} ELSE {_P_EN("p.replacement")} END AS pg
    FROM prop p JOIN ana a ON p.token = a.token AND p.lang = a.lang LEFT JOIN dict o ON p.token = o.key AND p.lang = o.lang LEFT JOIN dict n ON p.replacement = n.key AND p.lang <> n.lang
    LEFT JOIN dict x ON p.token = x.key AND p.lang <> x.lang LEFT JOIN svc s ON p.token = s.low),
    f2 AS (SELECT *, lang = 'en' AS en, has AND NOT nnever AS good, l BETWEEN 1 AND 4 AND has AND f >= 0.9992e0 AS ultra, round(pg - pt, 9) AS gain, CASE lang WHEN 'en' THEN sr ELSE se END AS sure,
        lang = 'ru' AND regexp_full_match(replacement, '[a-z]{{3,4}}') AND regexp_matches(replacement, '[aeiou]') AS tech, NOT (class IN ('Ambiguous', 'Unique')) OR anchor AS free FROM facts),
    f3 AS (SELECT *, known AND NOT (en AND coalesce(starget = 'ru', FALSE)) AS fixed, l <= 4 AND known AND NOT onever AND NOT ouser AND ultra AND CASE WHEN en THEN sr ELSE se OR sm END AS incontext,
        NOT known AND good AND CASE WHEN l = 1 THEN f >= 0.85e0 AND gain >= 0.15e0 WHEN l = 2 THEN f >= 0.90e0 OR (f >= 0.75e0 AND gain >= 0.12e0) WHEN l <= 4 THEN f >= 0.70e0 OR (f >= 0.55e0 AND sure) ELSE FALSE END AS exact,
        pg >= 0.70e0 AND NOT nnever AS named FROM f2),
    layout AS (SELECT token, replacement, lang, CASE
        WHEN starget = other AND lower(sword) = replacement THEN 'allow service_word' WHEN sword IS NOT NULL THEN 'wait other_service_word'
        WHEN l <= 4 AND NOT anchor AND NOT en AND replacement IN ({_AUTONOMOUS}) AND ultra AND gain >= 0.04e0 AND CASE WHEN known THEN incontext ELSE exact END THEN 'allow short_word'
        WHEN fixed AND incontext THEN 'allow known_in_context' WHEN fixed AND en AND has AND f >= 0.80e0 AND (anchor OR sr) THEN 'allow forced_in_context' WHEN fixed THEN 'no_change known_word'
        WHEN NOT en AND token = 'ррудщ' THEN CASE WHEN replacement = 'hello' THEN 'allow alias' ELSE 'wait other_alias' END
        WHEN NOT en AND l BETWEEN 3 AND 4 AND replacement IN ({_TECHNICAL}) AND good AND f >= 0.80e0 AND pg >= 0.78e0 AND pt < 0.90e0 THEN 'allow technical_word'
        WHEN en AND anchor AND NOT known AND good AND f >= 0.49e0 AND f < 0.70e0 THEN 'allow anchored_rare_word'
        WHEN class = 'Ambiguous' AND n_sources >= 1 AND NOT anchor THEN 'wait spelling_rivals' WHEN tech AND NOT named THEN 'wait unknown_short_name'
        WHEN en AND NOT known AND l <= 8 AND pt < 0.85e0 AND good AND f >= 0.70e0 AND free THEN 'allow reverse_image' WHEN known AND ofreq >= 0.70e0 AND token NOT IN ('мущ', 'пзг') THEN 'no_change strong_source'
        WHEN NOT en AND has AND f >= 0.70e0 AND free THEN 'allow frequent_image'
        WHEN NOT en AND l >= 3 AND good AND f >= 0.80e0 AND pg >= 0.82e0 AND (pt < 0.90e0 OR (tech AND named)) AND class = 'Ambiguous' AND n_sources = 0 THEN 'allow strong_image'
        WHEN tech AND named AND token IN ('мущ', 'пзг') THEN 'allow named_anchor' WHEN class = 'Unique' AND target <> replacement AND (NOT en OR NOT anchor) THEN 'wait other_spelling'
        WHEN class = 'Unique' AND rival THEN 'wait discarded_rival' WHEN class = 'Ambiguous' AND n_sources = 0 AND NOT anchor AND token NOT IN ('мущ', 'пзг') THEN 'wait no_spelling'
        WHEN tech AND NOT has THEN 'wait unknown_short_target' WHEN NOT (has AND f >= 0.70e0) THEN 'wait weak_target' WHEN crossed THEN 'wait known_in_target' ELSE 'allow image' END AS v FROM f3)"""


@_query(f"""WITH {_DICT}, {_SERVICE}, {_LAYOUT_PROPOSALS}, tk AS (SELECT DISTINCT token, lang FROM prop), {_ANALYSIS}, {_LAYOUT_VERDICTS}
    SELECT token, replacement, lang, split_part(v, ' ', 1) AS verdict, split_part(v, ' ', 2) AS rule FROM layout""")
def layout_decisions(spark, sf_dir):
    both, english, french, rare = two_dictionaries(spark, sf_dir)
    w, image, k = F.col("word"), T.to_russian_layout(F.col("word")), F.col("rank") % 3
    proposals = _hinted(french, w, image, "en", ru=k == 0).unionByName(_hinted(english, image, w, "ru", en=k == 1, some=k == 2)).unionByName(_hinted(rare, w, image, "en")).unionByName(_hinted(rare, image, w, "ru"))
    return D.layout_decisions(proposals, both)


# a word of the lexicon for each word outside it: its most frequent source; and the same for all slips of known words
_SLIPS = ", ".join(f"('{k}', '{v}')" for k, v in K.COMMON_SLIPS["en"].items())
_SPELLING = f"""tk AS (SELECT token, lang FROM prop GROUP BY ALL), {_ANALYSIS}, spelled AS (
    SELECT p.token, p.replacement, p.lang, CASE WHEN p.token = p.replacement THEN 'no_change nothing_to_do' WHEN sd.key IS NOT NULL THEN CASE WHEN slip.w = p.replacement THEN 'allow common_slip' ELSE 'wait other_slip' END
        WHEN o.key IS NOT NULL THEN 'no_change known_word' WHEN a.class <> 'Unique' OR a.target <> p.replacement THEN 'wait not_unique' WHEN a.rival THEN 'wait discarded_rival' WHEN NOT a.safe THEN 'wait unsafe' ELSE 'allow unique_source' END AS v
    FROM prop p JOIN ana a ON p.token = a.token AND p.lang = a.lang LEFT JOIN (VALUES {_SLIPS}) slip(t, w) ON p.token = slip.t AND p.lang = 'en' LEFT JOIN dict sd ON slip.w = sd.key AND sd.lang = 'en' LEFT JOIN dict o ON p.token = o.key AND p.lang = o.lang)"""
_FIRST = f"""(SELECT token, min_by(word, (-freq, word)) AS word FROM (SELECT token, word, freq FROM (SELECT word AS token, {_CUTS.format("word")} FROM counts WHERE n < 5 AND length(word) >= 3)
        JOIN (SELECT word, freq, {_CUTS.format("word")} FROM lex) USING (cut) WHERE token <> word AND {_ONE_EDIT}) GROUP BY 1)"""


def _first_words(rare: DataFrame, english: DataFrame) -> DataFrame:
    """token, word: the most frequent lexicon word one edit from each rare word of three letters."""
    pairs = C.one_edit_pairs(rare.filter(F.length("word") >= 3).select(F.col("word").alias("token")), english, ("freq",))
    return pairs.groupBy("token").agg(F.min(F.struct((-F.col("freq")).alias("f"), "word"))["word"].alias("word"))


@_query(f"""WITH {_DICT}, prop AS (SELECT token, word AS replacement, 'en' AS lang FROM {_FIRST} UNION ALL SELECT t, w, 'en' FROM (VALUES {_SLIPS}) s(t, w)
        UNION ALL SELECT word, 'the', 'en' FROM lex), {_SPELLING} SELECT token, replacement, lang, split_part(v, ' ', 1) AS verdict, split_part(v, ' ', 2) AS rule FROM spelled""")
def spelling_decisions(spark, sf_dir):
    both, english, _, rare = two_dictionaries(spark, sf_dir)
    en = F.lit("en").alias("lang")
    slips = english.sparkSession.createDataFrame(list(K.COMMON_SLIPS["en"].items()), "token string, replacement string").select("token", "replacement", en)
    found = _first_words(rare, english).select("token", F.col("word").alias("replacement"), en)
    return D.spelling_decisions(found.unionByName(slips).unionByName(english.select(F.col("word").alias("token"), F.lit("the").alias("replacement"), en)), both)


@_query(f"""WITH {_DICT}, {_SERVICE}, near0 AS {_FIRST}, prop AS (SELECT translate(token, '{Q._EN}', '{Q._RU}') AS token, token AS replacement, 'ru' AS lang, FALSE AS sr, FALSE AS se, FALSE AS sm FROM near0),
    tk AS (SELECT DISTINCT token, lang FROM prop), {_ANALYSIS}, {_LAYOUT_VERDICTS}
    SELECT token, replacement, lang, split_part(v, ' ', 1) AS verdict, split_part(v, ' ', 2) AS rule FROM layout
    UNION ALL SELECT translate(token, '{Q._EN}', '{Q._RU}'), word, 'ru', CASE WHEN d.key IS NOT NULL THEN 'no_change' ELSE 'wait' END, CASE WHEN d.key IS NOT NULL THEN 'known_word' ELSE 'known_replacement' END
        FROM near0 LEFT JOIN dict d ON translate(token, '{Q._EN}', '{Q._RU}') = d.key AND d.lang = 'ru'""")
def combined_decisions(spark, sf_dir):
    both, english, _, rare = two_dictionaries(spark, sf_dir)
    found, ru = stored(_first_words(rare, english), "first"), F.lit("ru").alias("lang")
    image = T.to_russian_layout(F.col("token")).alias("token")
    proposals = found.select(image, F.col("word").alias("replacement"), ru).unionByName(found.select(image, F.col("token").alias("replacement"), ru))
    return D.combined_decisions(proposals, both)
