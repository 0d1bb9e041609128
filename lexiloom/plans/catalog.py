"""Queries over the test tables that apply the library's operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import edits as E
from lexiloom.functions import text as T
from lexiloom.operators import audits as A
from lexiloom.operators import candidates as C
from lexiloom.operators import early as Y
from lexiloom.operators import events as V
from lexiloom.operators import gates as G
from lexiloom.operators import lookups as K
from lexiloom.operators import models as M
from lexiloom.operators import punctuation as P
from lexiloom.operators import sessions as N
from lexiloom.operators import spelling as L
from lexiloom.plans.decisions import decide
from lexiloom.sources import tables as S
from lexiloom.sources.shared import stored
from lexiloom.streaming import buffers as B
from lexiloom.streaming.tokens import as_input, completed_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL shared by the oracles

_WORDS = r"w AS (SELECT doc_id, lang, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, lang, regexp_extract_all(text, '\p{L}+') AS ws FROM documents))"
_TOKENS = r"tok AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]'), lambda t: t <> '') AS ts FROM documents))"
_COUNTS = "counts AS (SELECT lower(word) AS word, count(*) AS n FROM w WHERE lang = 'en' AND regexp_full_match(lower(word), '[a-z]+') GROUP BY 1)"
_LEX = "lex AS (SELECT word, n, rank, greatest(0.35e0, least(1.0e0, 1 - 0.65e0 * (rank - 1) / greatest(1, total - 1)))::DOUBLE AS freq FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank, count(*) OVER () AS total FROM counts WHERE n >= 5))"
_DISTINCT = "t AS (SELECT DISTINCT token FROM tok)"
_EN = T.EN_KEYS.replace("'", "''")
_RU = T.RU_KEYS.replace("'", "''")
_RARE = "rare AS (SELECT word AS token FROM counts WHERE n < 5 AND length(word) >= 3), long AS (SELECT * FROM lex WHERE length(word) >= 2)"
_NEAR = "near AS (SELECT token, word, freq, n FROM rare JOIN long ON abs(length(token) - length(word)) <= 1 AND token <> word AND damerau_levenshtein(token, word) = 1)"
_ADJ = f"strpos('{E.NEIGHBOUR_PAIRS}', '|' || was || now || '|') > 0"
_KIND = f"""kind AS (
    SELECT token, word, freq, CASE
        WHEN length(token) = length(word) + 1 AND len(list_filter(range(1, length(token)), lambda i: token[i] = token[i + 1] AND token[:i - 1] || token[i + 1:] = word)) > 0 THEN 'RepeatedAccidentalCharacter'
        WHEN length(token) = length(word) AND token[i + 1] <> word[i + 1] THEN 'AdjacentTransposition'
        WHEN length(token) = length(word) AND ({_ADJ}) THEN 'AdjacentKeySubstitution'
        WHEN length(token) = length(word) AND strpos('{E.VOWELS}', was) > 0 AND strpos('{E.VOWELS}', now) > 0 THEN 'VowelSubstitution'
        WHEN length(token) = length(word) THEN 'GeneralSubstitution'
        WHEN length(token) > length(word) THEN 'ExtraCharacter' ELSE 'MissingCharacter' END AS operation
    FROM (SELECT *, token[i] AS now, word[i] AS was FROM (SELECT *, list_min(list_filter(range(1, length(token) + 1), lambda i: token[i] <> word[i])) AS i FROM near))),
    src AS (SELECT token, word, operation, CASE operation {" ".join(f"WHEN '{k}' THEN {v}" for k, v in E.COSTS.items())} END::DOUBLE AS cost, freq FROM kind)"""
_BASE = f"WITH {_WORDS}, {_COUNTS}, {_LEX}, {_RARE}, {_NEAR}, {_KIND}"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents")


def _distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.token_rows(_docs(spark, sf_dir)).select("token").distinct()


def _rare_and_lexicon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every English word of three letters that is too rare for the lexicon, and the lexicon."""
    counts = S.english_counts(_docs(spark, sf_dir)).cache()  # read three times below; the vocabulary, not the corpus
    rare = counts.filter((F.col("n") < 5) & (F.length("word") >= 3)).select(F.col("word").alias("token"))
    return rare, S.ranked_lexicon(counts).filter("length(word) >= 2").select("word", "freq", "n")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare, lex = _rare_and_lexicon(spark, sf_dir)
    return C.mutation_sources(C.one_edit_pairs(rare, lex, ("freq",)), lex)


# lexicons and tokens


@_query(f"WITH {_WORDS}, {_COUNTS}, {_LEX} SELECT word, n, rank, round(freq, 9) AS freq FROM lex")
def lexicon(spark, sf_dir):
    return S.lexicon(_docs(spark, sf_dir)).select("word", "n", "rank", F.round("freq", 9).alias("freq"))


@_query(r"""SELECT doc_id, len(regexp_extract_all(text, '\p{L}+')) AS n_words, regexp_extract(text, '(\p{L}+)[^\p{L}]*$', 1) AS trailing,
    regexp_matches(rtrim(text), '[.!?]$') AS ends_sentence, regexp_matches(rtrim(text), '[,;:]$') AS ends_clause FROM documents""")
def text_shape(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.word_count(t).cast("long").alias("n_words"), T.trailing_word(t).alias("trailing"), T.ends_sentence(t).alias("ends_sentence"), T.ends_clause(t).alias("ends_clause"))


@_query(rf"""WITH {_TOKENS}, {_DISTINCT}, c AS (SELECT token, CASE WHEN token = '' THEN 'Empty' WHEN regexp_full_match(token, '[A-Za-z]+') THEN 'Latin'
    WHEN regexp_full_match(token, '[А-яЁё]+') THEN 'Cyrillic' WHEN regexp_full_match(token, '[A-Za-zА-яЁё]+') THEN 'Mixed' ELSE 'Other' END AS script FROM t),
    d AS (SELECT script, CASE WHEN script = 'Other' AND regexp_full_match(token, '[A-Za-z`~\[\];:''",.<>]+') AND regexp_matches(token, '[A-Za-z]') THEN 'Latin' ELSE script END AS layout_script FROM c)
    SELECT script, layout_script, count(*) AS n FROM d GROUP BY ALL""")
def script_classes(spark, sf_dir):
    t = F.col("token")
    return _distinct_tokens(spark, sf_dir).groupBy(T.script(t).alias("script"), T.script_for_layout(t).alias("layout_script")).agg(F.count(F.lit(1)).alias("n"))


@_query(rf"""WITH {_TOKENS}, {_DISTINCT}, f AS (SELECT token,
    contains(token, '://') OR regexp_matches(lower(token), '^(www\.|https?://)') AS url, regexp_matches(token, '^[^@]+@[^.]*\.') AS email,
    contains(token, '\') OR length(token) - length(replace(token, '/', '')) >= 2 OR regexp_matches(token, '^.+\.[A-Za-z0-9]{{2,5}}$') AS path,
    regexp_matches(token, '[_-]') OR regexp_matches(token, '\p{{Ll}}.*[\p{{Lu}}\p{{Lt}}]') AS identifier,
    NOT regexp_full_match(token, '[A-Za-z]+') AND NOT regexp_full_match(token, '[А-яЁё]+')
        AND NOT (regexp_full_match(token, '[A-Za-z`~\[\];:''",.<>]+') AND regexp_matches(token, '[A-Za-z]')) AS odd,
    regexp_matches(token, '\p{{Nd}}') AS digit FROM t)
    SELECT token, url, email, path, identifier, lower(token) IN ({", ".join(f"'{x.lower()}'" for x in T.TECHNICAL_NAMES)}) OR odd OR digit OR url OR email OR path OR identifier AS protected FROM f""")
def protected_tokens(spark, sf_dir):
    t = F.col("token")
    return _distinct_tokens(spark, sf_dir).select(
        "token", T.looks_like_url(t).alias("url"), T.looks_like_email(t).alias("email"), T.looks_like_path(t).alias("path"), T.looks_like_identifier(t).alias("identifier"), T.is_protected(t).alias("protected")
    )


_PLAUSIBLE = """CASE WHEN length({0}) = 1 THEN CASE WHEN regexp_full_match({0}, '[aeiouy]') THEN 0.45e0 ELSE 0.25e0 END WHEN NOT regexp_matches({0}, '[aeiouy]') THEN 0.12e0 ELSE
    greatest(0.0e0, least(1.0e0, 0.72e0 + CASE WHEN length({0}) >= 3 THEN 0.08e0 ELSE 0 END + CASE WHEN length({0}) >= 5 THEN 0.05e0 ELSE 0 END
    + CASE WHEN length(regexp_replace({0}, '[^aeiouy]', '', 'g')) / length({0}) BETWEEN 0.25e0 AND 0.60e0 THEN 0.05e0 WHEN length(regexp_replace({0}, '[^aeiouy]', '', 'g')) / length({0}) < 0.25e0 THEN -0.16e0 ELSE 0 END
    + CASE WHEN list_max(list_transform(regexp_split_to_array({0}, '[aeiouy]'), lambda r: length(r))) > 3 THEN -0.22e0 WHEN list_max(list_transform(regexp_split_to_array({0}, '[aeiouy]'), lambda r: length(r))) = 3 THEN -0.10e0 ELSE 0 END)) END"""


@_query(f"WITH {_WORDS}, {_COUNTS} SELECT word, round({_PLAUSIBLE.format('word')}::DOUBLE, 6) AS score FROM counts")
def plausibility(spark, sf_dir):
    return S.english_counts(_docs(spark, sf_dir)).select("word", F.round(T.english_plausibility(F.col("word")), 6).alias("score"))


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX} SELECT word, translate(word, '{_EN}', '{_RU}') AS typed, translate(translate(word, '{_EN}', '{_RU}'), '{_RU}', '{_EN}') AS restored FROM lex""")
def layout_images(spark, sf_dir):
    typed = T.to_russian_layout(F.col("word"))
    return S.lexicon(_docs(spark, sf_dir)).select("word", typed.alias("typed"), T.to_english_layout(typed).alias("restored"))


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX} SELECT a.word AS word, translate(a.word, '{_EN}', '{_RU}') AS typed, b.freq >= 0.55e0 AS lifted
    FROM lex a JOIN lex b ON translate(translate(a.word, '{_EN}', '{_RU}'), '{_RU}', '{_EN}') = b.word""")
def layout_image_join(spark, sf_dir):
    lex = S.lexicon(_docs(spark, sf_dir))
    typed = lex.select("word", T.to_russian_layout(F.col("word")).alias("typed")).withColumn("image", T.to_english_layout(F.col("typed")))
    known = C.sized(lex.select(F.col("word").alias("image"), "freq"))
    return typed.join(known, "image").select("word", "typed", (F.col("freq") >= 0.55).alias("lifted"))


@_query(rf"""WITH {_WORDS}, {_COUNTS}, {_LEX}, p AS (SELECT word, translate(word, '{_EN}', '{_RU}') AS typed, {_PLAUSIBLE.format('word')}::DOUBLE AS c FROM lex),
    v AS (SELECT *, length(regexp_replace(typed, '[^аеёиоуыэюя]', '', 'g')) AS nv, length(typed) AS n,
        list_max(list_transform(regexp_split_to_array(regexp_replace(typed, '[^аеёиоуыэюябвгджзйклмнпрстфхцчшщъь]', '', 'g'), '[аеёиоуыэюя]'), lambda r: length(r))) AS run FROM p),
    o AS (SELECT *, CASE WHEN n = 1 THEN CASE WHEN nv = 1 THEN 0.45e0 ELSE 0.25e0 END WHEN nv = 0 THEN 0.12e0 ELSE greatest(0.0e0, least(1.0e0, 0.72e0 + CASE WHEN n >= 3 THEN 0.08e0 ELSE 0 END + CASE WHEN n >= 5 THEN 0.05e0 ELSE 0 END
        + CASE WHEN nv / n BETWEEN 0.25e0 AND 0.60e0 THEN 0.05e0 WHEN nv / n < 0.25e0 THEN -0.16e0 ELSE 0 END + CASE WHEN run > 3 THEN -0.22e0 WHEN run = 3 THEN -0.10e0 ELSE 0 END)) END::DOUBLE AS o FROM v)
    SELECT word, typed, round((CASE WHEN o >= 0.70e0 AND c <= o THEN 0.0e0 WHEN c < 0.45e0 THEN greatest(0.0e0, least(0.35e0, c * 0.35e0)) WHEN c - o <= 0.05e0 THEN greatest(0.0e0, least(0.25e0, c - o)) ELSE
        greatest(0.0e0, least(0.95e0, (0.30e0 + (1 - o) * 0.30e0 + c * 0.30e0 + greatest(0.0e0, least(0.5e0, c - o)) * 0.20e0 + CASE WHEN c - o >= 0.20e0 THEN 0.08e0 ELSE 0 END)
        * CASE WHEN n <= 1 THEN 0.0e0 WHEN n = 2 THEN 0.45e0 WHEN n = 3 THEN 0.70e0 WHEN n = 4 THEN 0.85e0 ELSE 1.0e0 END)) END)::DOUBLE, 6) AS score FROM o""")
def layout_scores(spark, sf_dir):
    lex = S.lexicon(_docs(spark, sf_dir)).select("word", T.to_russian_layout(F.col("word")).alias("typed"))
    score = T.layout_score(F.col("typed"), F.col("word"), T.russian_plausibility(F.col("typed")), T.english_plausibility(F.col("word")))
    return lex.select("word", "typed", F.round(score, 6).alias("score"))


@_query(rf"""WITH {_TOKENS}, {_DISTINCT}, l AS (SELECT token, regexp_replace(token, '[^\p{{L}}]', '', 'g') AS s, 'abcDef' AS c FROM t)
    SELECT token, CASE WHEN s = '' THEN c WHEN regexp_full_match(s, '\p{{Lu}}+') THEN upper(c) WHEN NOT regexp_matches(s, '\p{{Lu}}') THEN lower(c)
        WHEN regexp_matches(s, '^\p{{Lu}}') AND NOT regexp_matches(s, '^.\p{{L}}*\p{{Lu}}') THEN upper(c[1]) || lower(c[2:]) WHEN regexp_matches(s, '^\p{{Lu}}') THEN upper(c[1]) || c[2:] ELSE c END AS cased FROM l""")
def case_transfer(spark, sf_dir):
    return _distinct_tokens(spark, sf_dir).select("token", T.transfer_case(F.col("token"), F.lit("abcDef")).alias("cased"))


@_query(f"""WITH {_WORDS}, {_COUNTS}, h AS (SELECT word, sha256(word) AS s FROM counts)
    SELECT CASE WHEN b % 10 < 8 THEN 'train' WHEN b % 10 = 8 THEN 'valid' ELSE 'test' END AS part, count(*) AS n, min(d) AS least_digest
    FROM (SELECT upper(s) AS d, ('0x' || s[1:2])::INTEGER AS b FROM h) GROUP BY 1""")
def hash_splits(spark, sf_dir):
    w = S.english_counts(_docs(spark, sf_dir))
    return w.groupBy(T.hash_split(F.col("word")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(T.digest(F.col("word"))).alias("least_digest"))


@_query(rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '\s+|[^\s\p{{L}}]+|\p{{L}}+') AS s, text FROM documents)
    SELECT doc_id, len(s) AS n_segments, len(list_filter(s, lambda x: regexp_full_match(x, '\p{{L}}+'))) AS n_words, array_to_string(s, '') = text AS lossless FROM p""")
def lossless_segments(spark, sf_dir):
    s = F.regexp_extract_all("text", F.lit(r"([ \t\n\r\f]+|[^ \t\n\r\f\p{L}]+|\p{L}+)"), F.lit(1))
    return _docs(spark, sf_dir).withColumn("s", s).select(
        "doc_id", F.size("s").cast("long").alias("n_segments"), F.size(F.filter("s", lambda x: x.rlike(r"^\p{L}+$"))).cast("long").alias("n_words"), (F.array_join("s", "") == F.col("text")).alias("lossless")
    )


# neighbours and candidates


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, a AS (SELECT word, length(word) AS n, range(1, length(word) + 1) AS places FROM lex)
    SELECT word, n::BIGINT AS n_deletions, (n - 1)::BIGINT AS n_transpositions, (25 * n)::BIGINT AS n_substitutions, (26 * (n + 1))::BIGINT AS n_insertions,
    len(list_filter(places, lambda i: i < n AND word[i] = word[i + 1])) AS n_cleanups FROM a""")
def neighbour_counts(spark, sf_dir):
    w = F.col("word")
    made = {"n_deletions": E.deletions(w), "n_transpositions": E.transpositions(w), "n_substitutions": E.substitutions(w), "n_insertions": E.insertions(w), "n_cleanups": E.repeat_cleanups(w)}
    return S.lexicon(_docs(spark, sf_dir)).select("word", *[F.size(v).cast("long").alias(k) for k, v in made.items()])


@_query(f"WITH {_WORDS}, {_COUNTS}, {_LEX}, {_RARE}, {_NEAR} SELECT token, word FROM near")
def one_edit_join(spark, sf_dir):
    rare, lex = _rare_and_lexicon(spark, sf_dir)
    return C.one_edit_pairs(rare, lex)


@_query(f"{_BASE} SELECT token, word, operation, cost, round(freq, 9) AS freq FROM src")
def mutation_sources(spark, sf_dir):
    return _sources(spark, sf_dir).withColumn("freq", F.round("freq", 9))


@_query(f"{_BASE} SELECT operation, count(*) AS n, count(DISTINCT token) AS tokens FROM src GROUP BY 1")
def edit_classes(spark, sf_dir):
    return _sources(spark, sf_dir).groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("tokens"))


@_query(f"{_BASE} SELECT token, rank, word FROM (SELECT token, word, row_number() OVER (PARTITION BY token ORDER BY cost, freq DESC, word) AS rank FROM src) WHERE rank <= 512")
def top_candidates(spark, sf_dir):
    return C.top_candidates(_sources(spark, sf_dir), 512).select("token", "rank", "word")


_GENERAL = "('VowelSubstitution', 'GeneralSubstitution', 'AdjacentKeySubstitution')"
_LENGTH = "('MissingCharacter', 'ExtraCharacter')"
_BANDS = f"""band AS (SELECT * FROM (SELECT *, min(cost) OVER (PARTITION BY token) AS least FROM src)
        WHERE cost <= least + 0.08e0 OR (cost <= least + 0.35e0 AND freq >= 0.50e0) OR (cost <= least + 0.20e0 AND freq >= 0.995e0)),
    met AS (SELECT a.token, a.word AS aw, a.cost AS ac, a.freq AS af, a.operation AS ao, b.word AS bw, b.cost AS bc, b.freq AS bf, b.operation AS bo FROM band a JOIN band b ON a.token = b.token AND a.word <> b.word),
    won AS (SELECT token, aw, bw, CASE
        WHEN ao IN {_LENGTH} AND af >= 0.999e0 AND bo = 'AdjacentKeySubstitution' AND af + 0.0001e0 >= bf THEN TRUE
        WHEN bo IN {_LENGTH} AND bf >= 0.999e0 AND ao = 'AdjacentKeySubstitution' AND bf + 0.0001e0 >= af THEN FALSE
        WHEN ac + 0.01e0 < bc THEN NOT (bf >= 0.995e0 AND bf >= af + 0.004e0)
        WHEN ac > bc + 0.08e0 THEN af >= 0.995e0 AND af >= bf + 0.004e0
        WHEN CASE WHEN ao = bo THEN ao WHEN bc + 0.01e0 < ac THEN bo WHEN af >= bf THEN ao ELSE bo END IN {_GENERAL} THEN (af >= 0.995e0 AND bf <= af - 0.004e0) OR (af >= 0.90e0 AND af >= bf + 0.12e0)
        ELSE af >= bf + 0.12e0 OR af >= 0.995e0 END AS wins FROM met),
    free AS (SELECT band.token, band.word FROM band LEFT JOIN (SELECT DISTINCT token, bw FROM won WHERE wins) x ON band.token = x.token AND band.word = x.bw WHERE x.bw IS NULL),
    alone AS (SELECT token, min(word) AS target FROM free GROUP BY 1 HAVING count(*) = 1),
    uniq AS (SELECT alone.token, target FROM alone LEFT JOIN won ON alone.token = won.token AND aw = target AND NOT wins GROUP BY 1, 2 HAVING count(won.token) = 0)"""


@_query(f"""{_BASE}, {_BANDS}, z AS (SELECT token, count(*) AS n_sources FROM src GROUP BY 1), y AS (SELECT token, count(*) AS n_band FROM band GROUP BY 1)
    SELECT z.token, n_sources, n_band, CASE WHEN target IS NULL THEN 'Ambiguous' ELSE 'Unique' END AS class, target FROM z JOIN y ON z.token = y.token LEFT JOIN uniq ON z.token = uniq.token""")
def mutation_classes(spark, sf_dir):
    return C.classify_mutations(_sources(spark, sf_dir))


@_query(f"{_BASE}, {_BANDS} SELECT token, word FROM free")
def undominated_sources(spark, sf_dir):
    return C.skyline(_sources(spark, sf_dir))


_PREFIX = "len(list_filter(range(1, least(length(w), length(p)) + 1), lambda k: w[:k] = p[:k]))"
_LEAD = "(wf >= 0.90e0 AND wf >= pf + 0.12e0 AND wc <= pc + 0.08e0)"
_ULTRA = "((wo IN ('MissingCharacter', 'ExtraCharacter') AND wf >= 0.999e0) OR (wo = 'AdjacentTransposition' AND wf >= 0.998e0))"
_RIVALS = f"""{_BASE}, {_BANDS},
    win AS (SELECT s.token, s.word AS w, s.operation AS wo, s.cost AS wc, s.freq AS wf FROM src s JOIN uniq u ON s.token = u.token AND s.word = u.target),
    duel AS (SELECT win.*, s.word AS p, s.operation AS po, s.cost AS pc, s.freq AS pf, length(win.w) AS nw, length(s.word) AS np
        FROM win JOIN src s ON win.token = s.token AND s.word <> win.w AND s.freq >= 0.70e0 AND s.cost <= win.wc + 0.70e0),
    h AS (SELECT *, {_PREFIX} AS head, len(list_filter(range(1, nw + 1), lambda i: w[i] <> p[i])) AS far, {_LEAD} AS lead, {_ULTRA} AS ultra FROM duel),
    x AS (SELECT *, right(p, greatest(nw - head, 0)) = w[head + 1:] AS tail, pf + 0.02e0 >= wf OR wf < 0.90e0 AS near FROM h),
    hit AS (SELECT token, unnest(list_filter([
        CASE WHEN np > nw AND ((po = 'MissingCharacter' AND wo = 'AdjacentKeySubstitution') OR (NOT lead AND po IN ('MissingCharacter', 'AdjacentTransposition', 'VowelSubstitution'))) THEN 'longer_structural' END,
        CASE WHEN ((wo = 'ExtraCharacter' AND po IN ('GeneralSubstitution', 'AdjacentKeySubstitution')) OR (wo = 'RepeatedAccidentalCharacter' AND po = 'AdjacentKeySubstitution')) AND np > nw AND NOT ends_with(p, w) THEN 'longer_without_suffix' END,
        CASE WHEN wo IN ('ExtraCharacter', 'RepeatedAccidentalCharacter') AND po = 'GeneralSubstitution' AND np > nw AND NOT starts_with(p, w) AND NOT ends_with(p, w)
            AND ((tail AND (head <= 2 OR near)) OR (NOT tail AND np = nw + 1 AND (head <= 1 OR near))) THEN 'internal_insertion' END,
        CASE WHEN wo = 'AdjacentTransposition' AND wf < 0.9995e0 AND nw = np AND (po = 'VowelSubstitution' OR (po = 'GeneralSubstitution' AND NOT (wf >= 0.96e0 AND pc >= wc + 0.08e0 AND wf - pf >= 0.07e0 AND wf - pf < 0.10e0)
            AND (pf >= wf OR list_sort(string_split(w, '')) = list_sort(string_split(p, '')) OR (wf >= 0.92e0 AND pf >= 0.75e0)))) THEN 'swapped_peer' END,
        CASE WHEN wo = 'MissingCharacter' AND NOT ultra AND np = nw - 1 AND po IN ('GeneralSubstitution', 'VowelSubstitution', 'AdjacentKeySubstitution', 'AdjacentTransposition')
            AND NOT (po = 'GeneralSubstitution' AND wf >= pf + 0.12e0 AND wf >= 0.95e0) THEN 'shorter_peer' END,
        CASE WHEN NOT lead AND po = 'GeneralSubstitution' AND wo IN ('ExtraCharacter', 'RepeatedAccidentalCharacter') AND np > nw AND starts_with(p, w) THEN 'suffix_extension' END,
        CASE WHEN NOT lead AND nw = np AND wo = 'MissingCharacter' AND po = 'MissingCharacter' THEN 'same_length_missing' END,
        CASE WHEN NOT lead AND wo IN ('AdjacentKeySubstitution', 'GeneralSubstitution') AND nw = np AND NOT ultra THEN 'same_length_near_cost' END,
        CASE WHEN wo = 'VowelSubstitution' AND po = 'GeneralSubstitution' AND nw = np AND ((far = 1 AND NOT ((wf >= 0.95e0 AND wf < 0.99e0) OR (wf >= 0.99e0 AND wf >= pf + 0.12e0))) OR (far = 2 AND wf < 0.98e0 AND head >= nw - 3)) THEN 'vowel_against_general' END,
        CASE WHEN wo = 'VowelSubstitution' AND po = 'VowelSubstitution' AND nw = np AND w <> p THEN 'vowel_against_vowel' END], lambda z: z IS NOT NULL)) AS rule FROM x)"""


def _winners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources = _sources(spark, sf_dir).cache()
    return sources, C.classify_mutations(sources).filter("class = 'Unique'").select("token", "target")


@_query(f"{_RIVALS} SELECT token, rule, count(*) AS n FROM hit GROUP BY 1, 2")
def rival_rules(spark, sf_dir):
    return G.rival_rules(*_winners(spark, sf_dir))


@_query(f"""{_RIVALS} SELECT win.token, w AS target, CASE WHEN (CASE WHEN wo IN ('ExtraCharacter', 'MissingCharacter') THEN wf >= 0.70e0 WHEN wo = 'AdjacentTransposition' THEN TRUE ELSE wf >= 0.65e0 END)
    AND (win.token NOT IN (SELECT token FROM hit) OR (wo = 'AdjacentTransposition' AND wf >= 0.9995e0)) THEN 'apply' ELSE 'wait' END AS decision FROM win""")
def guarded_decisions(spark, sf_dir):
    return G.guarded_decisions(*_winners(spark, sf_dir))


@_query(f"WITH {_WORDS}, {_COUNTS}, {_LEX} SELECT c.word AS token, l.word AS word FROM (SELECT * FROM counts WHERE n < 5) c JOIN lex l ON starts_with(c.word, l.word)")
def dictionary_prefixes(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    counts = S.english_counts(docs).cache()
    return C.dictionary_prefixes(counts.filter("n < 5").select(F.col("word").alias("token")), S.ranked_lexicon(counts).cache())


@_query(rf"""WITH {_WORDS}, {_COUNTS}, {_LEX}, x AS (SELECT doc_id, lower(word) AS word FROM w)
    SELECT doc_id, count(*) AS n, count(l.word) AS known, round(coalesce(avg(l.freq), 0), 6) AS mean_freq FROM x LEFT JOIN lex l ON x.word = l.word GROUP BY 1""")
def composite_lookup(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    known = C.sized(S.lexicon(docs).select(F.col("word").alias("known"), "freq").cache())
    rows = S.word_rows(docs).join(known, F.lower("word") == F.col("known"), "left")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"), F.round(F.coalesce(F.avg("freq"), F.lit(0.0)), 6).alias("mean_freq"))


# models

_BI = "bi AS (SELECT w1, w2, count(*) AS n FROM (SELECT lag(lower(word)) OVER (PARTITION BY doc_id ORDER BY pos) AS w1, lower(word) AS w2 FROM w) WHERE w1 IS NOT NULL GROUP BY 1, 2)"
_TRI = "tri AS (SELECT w1, w2, w3, count(*) AS n FROM (SELECT lag(lower(word), 2) OVER (PARTITION BY doc_id ORDER BY pos) AS w1, lag(lower(word)) OVER (PARTITION BY doc_id ORDER BY pos) AS w2, lower(word) AS w3 FROM w) WHERE w1 IS NOT NULL GROUP BY 1, 2, 3)"
_BEST2 = "b2 AS (SELECT w1, total, w2 AS best, n FROM (SELECT *, sum(n) OVER (PARTITION BY w1) AS total, row_number() OVER (PARTITION BY w1 ORDER BY n DESC, w2) AS k FROM bi) WHERE k = 1 AND total >= 5)"
_BEST3 = "b3 AS (SELECT w1, w2, w3 AS best FROM (SELECT *, sum(n) OVER (PARTITION BY w1, w2) AS total, row_number() OVER (PARTITION BY w1, w2 ORDER BY n DESC, w3) AS k FROM tri) WHERE k = 1 AND total >= 5)"


@_query(f"WITH {_WORDS}, {_BI}, {_BEST2} SELECT w1, total::BIGINT AS total, best, n FROM b2")
def bigram_continuations(spark, sf_dir):
    return M.best_continuations(M.bigram_counts(_docs(spark, sf_dir)), ["w1"], "w2", 5)


@_query(f"""WITH {_WORDS}, {_BI}, {_TRI}, {_BEST2}, {_BEST3}, c AS (SELECT DISTINCT w1, w2 FROM bi)
    SELECT c.w1, c.w2, coalesce(b3.best, b2.best) AS best, CASE WHEN b3.best IS NOT NULL THEN 3 WHEN b2.best IS NOT NULL THEN 2 END::BIGINT AS "order"
    FROM c LEFT JOIN b3 ON c.w1 = b3.w1 AND c.w2 = b3.w2 LEFT JOIN b2 ON c.w2 = b2.w1""")
def next_words(spark, sf_dir):
    return M.continuations(_docs(spark, sf_dir), 5)


@_query(f"WITH {_WORDS}, {_COUNTS}, {_LEX} SELECT prefix, count(*) AS n FROM (SELECT unnest(list_transform(range(1, least(length(word), 10) + 1), lambda k: word[:k])) AS prefix FROM lex) GROUP BY 1")
def prefix_counts(spark, sf_dir):
    return M.prefix_counts(S.lexicon(_docs(spark, sf_dir)))


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, r AS (SELECT freq, unnest(list_transform(range(1, length(word) + 1), lambda i: ('^^' || word)[i:i + 2])) AS t FROM lex),
    g AS (SELECT t[1] AS a, t[2] AS b, t[3] AS c, sum(freq * freq) AS n FROM r GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY b, c) AS nb, sum(n) OVER (PARTITION BY b) AS tb, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER () AS tt, sum(n) OVER (PARTITION BY a, b) AS ta FROM g)
    SELECT a, b, c, round(ln((n + 2 * ((nb + 2 * ((nc + 0.1) / (tt + 3.4))) / (tb + 2))) / (ta + 2)), 6) AS logp FROM s""")
def character_trigrams(spark, sf_dir):
    lex = S.lexicon(_docs(spark, sf_dir)).select("word", (F.col("freq") * F.col("freq")).alias("weight"))
    return M.character_trigrams(lex).withColumn("logp", F.round("logp", 6))


# events


@_query("""SELECT event_id, list_sort(s)[ceil(len(s) * 0.95)::BIGINT] AS p95 FROM (SELECT event_id, list(greatest(value, 0.0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 255 PRECEDING AND CURRENT ROW) AS s FROM events)""")
def rolling_p95(spark, sf_dir):
    return V.rolling_p95(S.read(spark, sf_dir, "events"))


@_query("""SELECT event_type, count(value) AS n, round(avg(greatest(value, 0.0)), 6) AS avg, max(greatest(value, 0.0)) AS max, quantile_disc(greatest(value, 0.0), 0.95) AS p95 FROM events GROUP BY 1""")
def duration_summary(spark, sf_dir):
    return V.duration_summary(S.read(spark, sf_dir, "events"), "event_type").withColumn("avg", F.round("avg", 6))


@_query("SELECT user_id, event_id, back FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 50")
def last_events(spark, sf_dir):
    return V.last_events(S.read(spark, sf_dir, "events"), "user_id").select("user_id", "event_id", "back")


@_query("""SELECT event_id, gap AS gap_ms FROM (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) / 1000 AS gap FROM events) WHERE gap <= 3600000""")
def double_taps(spark, sf_dir):
    return V.double_taps(S.read(spark, sf_dir, "events"), 3_600_000)


@_query(rf"""WITH {_TOKENS}, s AS (SELECT doc_id, pos, regexp_full_match(token, '[A-Za-z]+')::INT AS l, regexp_full_match(token, '[А-яЁё]+')::INT AS c FROM tok),
    v AS (SELECT doc_id, sum(l) OVER x AS en, sum(c) OVER x AS ru FROM s WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
    d AS (SELECT doc_id, CASE WHEN ru >= greatest(en + 2, 2) THEN 'ru' WHEN en >= greatest(ru + 2, 2) THEN 'en' WHEN ru > en AND ru >= 3 THEN 'ru' WHEN en > ru AND en >= 3 THEN 'en' END AS dominant FROM v)
    SELECT doc_id, dominant, count(*) AS n FROM d GROUP BY ALL""")
def language_votes(spark, sf_dir):
    votes = V.language_votes(S.token_rows(_docs(spark, sf_dir)), T.script(F.col("token")))
    return votes.groupBy("doc_id", "dominant").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH c AS (SELECT event_id AS id, event_id % 13 <> 0 AS enabled, event_id % 11 = 0 AS paused, CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'unknown' ELSE 'no' END AS secure, event_type AS app, event_id % 7 = 0 AS safe_mode FROM events)
    SELECT id, CASE WHEN NOT enabled THEN 'Disabled' WHEN paused THEN 'Paused' WHEN secure = 'yes' THEN 'SecureInput' WHEN secure = 'unknown' THEN 'UnknownContext'
    WHEN lower(trim(app)) IN ('click', 'view') THEN 'ExcludedApplication' WHEN safe_mode THEN 'SafeMode' ELSE 'Allowed' END AS state FROM c""")
def safety_states(spark, sf_dir):
    e = F.col("event_id")
    secure = F.when(e % 5 == 0, "yes").when(e % 5 == 1, "unknown").otherwise("no")
    context = S.read(spark, sf_dir, "events").select(e.alias("id"), (e % 13 != 0).alias("enabled"), (e % 11 == 0).alias("paused"), secure.alias("secure"), F.col("event_type").alias("app"), (e % 7 == 0).alias("safe_mode"))
    return V.safety_state(context, spark.createDataFrame([(" Click",), ("VIEW ",), ("click",)], "app string"))


@_query("""WITH r AS (SELECT event_type AS kind, (user_id % 50)::VARCHAR AS candidate, (event_id % 3)::VARCHAR AS replacement, event_id % 2 AS undo_count, CASE WHEN event_id % 4 = 0 THEN value END AS weight, event_id AS seq FROM events)
    SELECT kind, candidate, replacement, sum(undo_count)::BIGINT AS undo_count, arg_max(weight, seq) FILTER (WHERE weight IS NOT NULL) AS weight, sum(undo_count) >= 2 AS suppressed FROM r GROUP BY 1, 2, 3""")
def rejection_merge(spark, sf_dir):
    e = F.col("event_id")
    rows = S.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), (F.col("user_id") % 50).cast("string").alias("candidate"), (e % 3).cast("string").alias("replacement"), (e % 2).alias("undo_count"), F.when(e % 4 == 0, F.col("value")).alias("weight"), e.alias("seq")
    )
    return V.merge_rejections(rows)


@_query("""WITH e AS (SELECT event_type AS lang, lower(trim((user_id % 97)::VARCHAR)) AS key, event_id AS seq, value AS freq FROM events)
    SELECT lang, key, arg_max(freq, seq) AS freq FROM e GROUP BY 1, 2""")
def user_dictionary(spark, sf_dir):
    rows = S.read(spark, sf_dir, "events").select(F.col("event_type").alias("lang"), (F.col("user_id") % 97).cast("string").alias("word"), F.col("event_id").alias("seq"), F.col("value").alias("freq"))
    return V.last_entries(rows)


@_query("""WITH s(id, trigger, slang, case_sensitive, enabled, apps_on, apps_off) AS (VALUES
        ('a', 'Click', NULL, FALSE, TRUE, []::VARCHAR[], []::VARCHAR[]), ('b', 'click', 'en', TRUE, TRUE, ['App1']::VARCHAR[], []::VARCHAR[]),
        ('c', 'VIEW', NULL, FALSE, TRUE, []::VARCHAR[], ['app2']::VARCHAR[]), ('d', 'view', NULL, FALSE, FALSE, []::VARCHAR[], []::VARCHAR[])),
    r AS (SELECT event_id AS req_id, event_type AS typed, CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'ru' END AS lang, 'app' || (event_id % 4) AS app FROM events),
    m AS (SELECT req_id, id, trigger, CASE WHEN slang IS NULL THEN 0 ELSE 2 END + CASE WHEN len(apps_on) > 0 THEN 1 ELSE 0 END AS score FROM r JOIN s ON lower(typed) = lower(trigger)
        WHERE enabled AND (slang IS NULL OR slang = lang) AND (NOT case_sensitive OR typed = trigger)
        AND (len(apps_on) = 0 OR list_contains(list_transform(apps_on, lambda a: lower(a)), lower(app))) AND NOT list_contains(list_transform(apps_off, lambda a: lower(a)), lower(app)))
    SELECT req_id, id FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, trigger, id) AS k FROM m) WHERE k = 1""")
def snippet_matches(spark, sf_dir):
    schema = "id string, trigger string, slang string, case_sensitive boolean, enabled boolean, apps_on array<string>, apps_off array<string>"
    rows = [("a", "Click", None, False, True, [], []), ("b", "click", "en", True, True, ["App1"], []), ("c", "VIEW", None, False, True, [], ["app2"]), ("d", "view", None, False, False, [], [])]
    e = F.col("event_id")
    requests = S.read(spark, sf_dir, "events").select(e.alias("req_id"), F.col("event_type").alias("typed"), F.when(e % 2 == 0, "en").otherwise("ru").alias("lang"), F.concat(F.lit("app"), (e % 4).cast("string")).alias("app"))
    return V.match_snippets(requests, spark.createDataFrame(rows, schema))


_INPUT = """i AS (SELECT event_id, ts, user_id AS key, CASE WHEN event_id % 7 = 0 THEN 'Boundary' WHEN event_id % 23 = 0 THEN 'Reset' WHEN event_id % 11 = 0 THEN 'Backspace' ELSE 'Character' END AS kind,
    substr('abcdefghijklmnopqrstuvwxyz', (event_id % 26 + 1)::INT, 1) AS ch FROM events)"""


@_query(f"""WITH {_INPUT}, r AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('Boundary', 'Reset') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM i),
    g AS (SELECT key, run, list(CASE WHEN kind = 'Backspace' THEN '-' ELSE ch END ORDER BY ts, event_id) FILTER (WHERE kind IN ('Character', 'Backspace')) AS items, max(event_id) FILTER (WHERE kind = 'Boundary') AS event_id FROM r GROUP BY 1, 2)
    SELECT key, event_id, token FROM (SELECT key, event_id, list_reduce(list_prepend('', items), lambda s, e: CASE WHEN e = '-' THEN left(s, greatest(length(s) - 1, 0)) WHEN length(s) >= 48 THEN '' ELSE s || e END) AS token FROM g WHERE event_id IS NOT NULL) WHERE token <> ''""")
def completed_input_tokens(spark, sf_dir):
    return completed_tokens(as_input(S.read(spark, sf_dir, "events")))


# punctuation

_QS = ", ".join(f"'{x}'" for x in P.QUESTION_STARTS)
_CB = ", ".join(f"'{x}'" for x in P.COMMA_BEFORE)
_PROP = rf"""t AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split(text, ' '), lambda x: x <> '') AS tok FROM conversations),
    b AS (SELECT *, list_transform(tok, lambda x: lower(regexp_replace(x, '^[''’"]+|[''’"]+$', '', 'g'))) AS bare FROM t WHERE len(tok) > 0),
    p AS (SELECT id, len(tok) - 1 AS after_token, CASE WHEN bare[1] IN ({_QS}) THEN '?' ELSE '.' END AS mark, CASE WHEN bare[1] IN ({_QS}) THEN 0.94 ELSE 0.92 END::DOUBLE AS probability FROM b
        UNION ALL SELECT id, i - 2, ',', 0.92 FROM (SELECT id, bare, unnest(range(2, len(bare) + 1)) AS i FROM b) WHERE bare[i] IN ({_CB}) AND length(bare[i - 1]) > 1 AND bare[i - 1] NOT IN ({_CB}))"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


@_query(f"WITH {_PROP} SELECT id, after_token::BIGINT AS after_token, mark, probability FROM p")
def punctuation_proposals(spark, sf_dir):
    return P.proposals(_turns(spark, sf_dir))


@_query(f"WITH {_PROP} SELECT id, after_token::BIGINT AS after_token, mark, probability FROM (SELECT *, row_number() OVER (PARTITION BY id, after_token ORDER BY probability DESC, mark) AS k FROM p) WHERE k = 1")
def selected_proposals(spark, sf_dir):
    return P.select_proposals(P.proposals(_turns(spark, sf_dir)))


@_query(rf"SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '(\p{{L}}) ([.,;:!?])(\s|$)', '\1\2\3', 'g') AS text FROM conversations")
def closed_up_text(spark, sf_dir):
    return _turns(spark, sf_dir).select("id", P.close_up(F.col("text")).alias("text"))


# farther candidates and sessions

_FAR = """far AS (SELECT * FROM (SELECT token, word, freq, damerau_levenshtein(token, word)::BIGINT AS distance FROM rare JOIN long ON abs(length(token) - length(word)) <= 2 AND token <> word) WHERE distance <= 2),
    nearest AS (SELECT * FROM far QUALIFY distance = min(distance) OVER (PARTITION BY token)),
    cand AS (SELECT *, count(*) OVER (PARTITION BY token) AS n, row_number() OVER (PARTITION BY token ORDER BY freq DESC, word) AS rank FROM nearest),
    scored AS (SELECT *, 0.76e0 + 0.12e0 * freq - CASE WHEN n > 1 THEN 0.08e0 ELSE 0 END - 0.10e0 * (distance - 1) AS score FROM cand WHERE rank <= 16)"""


def _scored(rare: DataFrame, lex: DataFrame) -> DataFrame:
    found = L.two_edit_candidates(rare, lex)
    return found.withColumn("score", L.external_score(F.col("distance"), F.col("freq"), F.col("n")))


@_query(f"WITH {_WORDS}, {_COUNTS}, {_LEX}, {_RARE}, {_FAR} SELECT token, word, distance, rank, n, round(score, 9) AS score FROM scored")
def two_edit_candidates(spark, sf_dir):
    return _scored(*_rare_and_lexicon(spark, sf_dir)).select("token", "word", "distance", "rank", "n", F.round("score", 9).alias("score"))


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, {_RARE}, {_FAR}, o AS (
        SELECT token, 'spelling' AS kind, word, score + 0.06e0 AS score FROM scored
        UNION ALL SELECT translate(token, '{_EN}', '{_RU}'), 'combined', word, score + 0.04e0 FROM scored
        UNION ALL SELECT translate(word, '{_EN}', '{_RU}'), 'layout', word, 0.86e0 FROM long WHERE freq >= 0.55e0),
    r AS (SELECT *, row_number() OVER x AS k, lead(score) OVER x AS second FROM o WINDOW x AS (PARTITION BY token ORDER BY score DESC, list_position(['combined', 'spelling', 'layout'], kind), word))
    SELECT token, kind, word, CASE WHEN second >= 0.45e0 AND round(score - second, 9) <= 0.05e0 THEN 'wait' WHEN score >= 0.70e0 THEN 'apply' WHEN score >= 0.45e0 THEN 'wait' ELSE 'no_change' END AS decision FROM r WHERE k = 1""")
def joint_decisions(spark, sf_dir):
    rare, lex = _rare_and_lexicon(spark, sf_dir)
    best = stored(_scored(rare, lex), "scored")  # read twice below
    spelling = best.select("token", F.lit("spelling").alias("kind"), "word", (F.col("score") + 0.06).alias("score"))
    combined = best.select(T.to_russian_layout(F.col("token")).alias("token"), F.lit("combined").alias("kind"), "word", (F.col("score") + 0.04).alias("score"))
    layout = lex.filter("freq >= 0.55").select(T.to_russian_layout(F.col("word")).alias("token"), F.lit("layout").alias("kind"), "word", F.lit(0.86).alias("score"))
    return L.joint_decisions(spelling.unionByName(combined).unionByName(layout))


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, z AS (SELECT word, freq, ('0x' || sha256(word)[1:2])::INTEGER % 10 AS b FROM lex),
    r AS (SELECT freq, unnest(list_transform(range(1, length(word) + 1), lambda i: ('^^' || word)[i:i + 2])) AS t FROM z WHERE b < 8),
    g AS (SELECT t[1] AS a, t[2] AS b, t[3] AS c, sum(freq * freq) AS n FROM r GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY b, c) AS nb, sum(n) OVER (PARTITION BY b) AS tb, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER () AS tt, sum(n) OVER (PARTITION BY a, b) AS ta FROM g),
    p AS (SELECT a || b || c AS t, ln((n + 2 * ((nb + 2 * ((nc + 0.1) / (tt + 3.4))) / (tb + 2))) / (ta + 2)) AS logp FROM s),
    x AS (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: ('^^' || word)[i:i + 2])) AS t FROM z WHERE b = 9)
    SELECT word, round(avg(coalesce(logp, -8.0)), 6) AS mean_logp, count(*) AS n FROM x LEFT JOIN p USING (t) GROUP BY word""")
def word_likelihoods(spark, sf_dir):
    lex = S.lexicon(_docs(spark, sf_dir)).withColumn("part", T.hash_split(F.col("word"))).cache()
    model = M.character_trigrams(lex.filter("part = 'train'").select("word", (F.col("freq") * F.col("freq")).alias("weight")))
    return M.mean_log_likelihood(lex.filter("part = 'test'").select("word"), model).withColumn("mean_logp", F.round("mean_logp", 6))


@_query(rf"""WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(text, '\p{{L}}+') AS ws FROM conversations),
    w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM t),
    l AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS last FROM w),
    f AS (SELECT *, list_max(list_filter(range(1, len(last) + 1), lambda n: length(array_to_string(last[len(last) - n + 1:], ' ')) <= 40)) AS n FROM l)
    SELECT doc_id, pos, coalesce(array_to_string(last[len(last) - n + 1:], ' '), '') AS context FROM f""")
def prediction_contexts(spark, sf_dir):
    words = _turns(spark, sf_dir).select(F.col("id").alias("doc_id"), F.posexplode(T.words(F.col("text"))).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))
    return N.prediction_contexts(words, chars=40)


@_query("""WITH e AS (SELECT event_id, user_id, ts, CASE event_id % 5 WHEN 0 THEN 'Correction' WHEN 1 THEN 'Undo' ELSE 'Other' END AS kind FROM events),
    n AS (SELECT *, lead(kind) OVER x AS k2, lead(event_id) OVER x AS undo_id, (lead(epoch_us(ts)) OVER x - epoch_us(ts)) / 1000 AS age_ms FROM e WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, undo_id, age_ms FROM n WHERE kind = 'Correction' AND k2 = 'Undo' AND age_ms <= 7200000""")
def undone_corrections(spark, sf_dir):
    kind = F.when(F.col("event_id") % 5 == 0, "Correction").when(F.col("event_id") % 5 == 1, "Undo").otherwise("Other")
    return N.undone(S.read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("key"), kind.alias("kind")), 7_200_000)


# sets, audits and decisions


@_query(f"WITH {_WORDS}, a AS (SELECT DISTINCT lower(word) AS word FROM w WHERE lang = 'en'), b AS (SELECT DISTINCT lower(word) AS word FROM w WHERE lang <> 'en') SELECT word, side FROM (SELECT word, 'en_only' AS side FROM a EXCEPT SELECT word, 'en_only' FROM b UNION ALL (SELECT word, 'other_only' FROM b EXCEPT SELECT word, 'other_only' FROM a))")
def vocabulary_difference(spark, sf_dir):
    w = S.word_rows(_docs(spark, sf_dir)).select(F.lower("word").alias("word"), (F.col("lang") == "en").alias("en"))
    sides = w.groupBy("word").agg(F.bool_or("en").alias("a"), F.bool_or(~F.col("en")).alias("b")).filter(F.col("a") != F.col("b"))
    return sides.select("word", F.when(F.col("a"), "en_only").otherwise("other_only").alias("side"))


_DECIDE = rf"""{_TOKENS}, {_WORDS}, {_COUNTS}, {_LEX}, {_DISTINCT}, m AS (SELECT token, lower(token) AS low,
        NOT regexp_full_match(token, '[A-Za-z]+') AND NOT (regexp_full_match(token, '[A-Za-z`~\[\];:''",.<>]+') AND regexp_matches(token, '[A-Za-z]')) AND NOT regexp_full_match(token, '[А-яЁё]+')
        OR lower(token) IN ({", ".join(f"'{x.lower()}'" for x in T.TECHNICAL_NAMES)}) OR contains(token, '://') OR regexp_matches(lower(token), '^(www\.|https?://)') OR regexp_matches(token, '^.+\.[A-Za-z0-9]{{2,5}}$')
        OR regexp_matches(token, '\p{{Ll}}.*[\p{{Lu}}\p{{Lt}}]') AS protected FROM t),
    rare AS (SELECT DISTINCT low AS token FROM m WHERE NOT protected AND low NOT IN (SELECT word FROM lex) AND length(low) >= 3), long AS (SELECT * FROM lex), {_NEAR}, {_KIND},
    {_BANDS}, u AS (SELECT q.token AS low, uniq.target, lex.freq AS f FROM (SELECT DISTINCT token FROM src) q LEFT JOIN uniq ON q.token = uniq.token LEFT JOIN lex ON uniq.target = lex.word),
    d AS (SELECT m.token, CASE WHEN protected THEN 'protected' WHEN m.low IN (SELECT word FROM lex) THEN 'known' WHEN u.low IS NULL THEN 'no_source' WHEN u.target IS NULL THEN 'ambiguous' WHEN f >= 0.70 THEN 'unique' ELSE 'rare_target' END AS reason FROM m LEFT JOIN u ON m.low = u.low)"""


@_query(f"WITH {_DECIDE} SELECT CASE WHEN reason = 'unique' THEN 'apply' WHEN reason IN ('ambiguous', 'rare_target') THEN 'wait' ELSE 'no_change' END AS decision, reason, count(*) AS n, sum(('0x' || sha256(token)[1:12])::BIGINT)::VARCHAR AS fingerprint FROM d GROUP BY ALL")
def decision_summary(spark, sf_dir):
    d = decide(_distinct_tokens(spark, sf_dir).cache(), S.lexicon(_docs(spark, sf_dir)).cache())
    # a sum of digests does not depend on the order of rows and is added up before the shuffle
    each = F.conv(F.substring(F.sha2("token", 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return d.groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(each).cast("string").alias("fingerprint"))


@_query(f"WITH {_DECIDE} SELECT count(*) AS examined, count(*) FILTER (WHERE reason = 'unique') AS apply, count(*) FILTER (WHERE reason IN ('ambiguous', 'rare_target')) AS wait, count(*) FILTER (WHERE reason IN ('protected', 'known', 'no_source')) AS no_change FROM d")
def gate_counters(spark, sf_dir):
    d = decide(_distinct_tokens(spark, sf_dir).cache(), S.lexicon(_docs(spark, sf_dir)).cache())
    count = lambda x: F.count_if(F.col("decision") == x).alias(x)
    return d.agg(F.count(F.lit(1)).alias("examined"), count("apply"), count("wait"), count("no_change"))


# audits

_SPLIT = "CASE WHEN ('0x' || sha256(word)[1:2])::INTEGER % 10 < 8 THEN 'train' WHEN ('0x' || sha256(word)[1:2])::INTEGER % 10 = 8 THEN 'valid' ELSE 'test' END"
@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, long AS (SELECT * FROM lex WHERE length(word) >= 2), q AS (SELECT word, n, length(word) AS l, (n + 1) % 3 AS kind, (n * 7 + 1) % length(word) AS p, (n * 7 + 1) % (length(word) - 1) AS i FROM long WHERE length(word) >= 4),
    m AS (SELECT word, CASE kind WHEN 0 THEN 'delete' WHEN 1 THEN 'swap' ELSE 'repeat' END AS slip,
        CASE kind WHEN 0 THEN left(word, p) || word[p + 2:] WHEN 1 THEN left(word, i) || word[i + 2] || word[i + 1] || word[i + 3:] ELSE left(word, p + 1) || word[p + 1:] END AS mutation FROM q),
    rare AS (SELECT DISTINCT mutation AS token FROM m WHERE mutation <> word AND mutation NOT IN (SELECT word FROM long)), {_NEAR}, {_KIND}, {_BANDS}, found AS (SELECT DISTINCT token FROM src)
    SELECT slip, CASE WHEN mutation IN (SELECT word FROM long) THEN 'valid_word' WHEN found.token IS NULL THEN 'no_source' WHEN target IS NULL THEN 'ambiguous' WHEN target = m.word THEN 'recovered' ELSE 'wrong' END AS outcome, count(*) AS n
    FROM m LEFT JOIN found ON m.mutation = found.token LEFT JOIN uniq ON m.mutation = uniq.token WHERE mutation <> m.word GROUP BY ALL""")
def slip_recovery(spark, sf_dir):
    lex = S.lexicon(_docs(spark, sf_dir)).filter("length(word) >= 2").select("word", "freq", "n").cache()
    return A.recovery(A.seeded_slips(lex.filter("length(word) >= 4")), lex)


@_query(f"""{_BASE}, {_BANDS}, a AS (SELECT token, target AS ta FROM uniq), t AS (SELECT token, word AS tb, row_number() OVER (PARTITION BY token ORDER BY cost, freq DESC, word) AS k FROM src),
    j AS (SELECT ta, tb FROM a FULL JOIN (SELECT * FROM t WHERE k = 1) t ON a.token = t.token)
    SELECT count(*) AS tokens, count(*) FILTER (WHERE ta = tb) AS agree, count(*) FILTER (WHERE ta <> tb) AS differ, count(*) FILTER (WHERE tb IS NULL) AS only_a, count(*) FILTER (WHERE ta IS NULL) AS only_b FROM j""")
def provider_comparison(spark, sf_dir):
    sources = _sources(spark, sf_dir).cache()
    first = C.top_candidates(sources, 1).select("token", F.col("word").alias("target"))
    return A.compare_providers(C.classify_mutations(sources).select("token", "target"), first)


@_query(f"WITH {_WORDS}, {_COUNTS}, {_LEX}, {_RARE}, {_NEAR} SELECT 'both' AS side, count(*) AS n FROM near")
def candidate_set_difference(spark, sf_dir):
    rare, lex = _rare_and_lexicon(spark, sf_dir)
    return A.set_difference(C.one_edit_pairs(rare, lex), C.generated_pairs(rare, lex), ["token", "word"])


@_query(f"""{_RIVALS}, f AS (SELECT win.token, CASE WHEN (CASE WHEN wo IN ('ExtraCharacter', 'MissingCharacter') THEN wf >= 0.70e0 WHEN wo = 'AdjacentTransposition' THEN TRUE ELSE wf >= 0.65e0 END)
        AND (win.token NOT IN (SELECT token FROM hit) OR (wo = 'AdjacentTransposition' AND wf >= 0.9995e0)) THEN 'apply' ELSE 'wait' END AS second, CASE WHEN wf >= 0.70e0 THEN 'apply' ELSE 'wait' END AS first FROM win)
    SELECT first, count(*) FILTER (WHERE second = 'apply') AS apply, count(*) FILTER (WHERE second = 'wait') AS wait FROM f GROUP BY 1""")
def outcome_matrix(spark, sf_dir):
    sources, winners = _winners(spark, sf_dir)
    freq = sources.select("token", F.col("word").alias("target"), "freq").join(winners, ["token", "target"])
    plain = freq.select("token", F.when(F.col("freq") >= 0.70, "apply").otherwise("wait").alias("decision"))
    return A.outcome_matrix(plain, G.guarded_decisions(sources, winners), ["apply", "wait"])


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, s AS (SELECT word, {_SPLIT} AS part FROM lex),
    seen AS (SELECT prefix, count(*) AS c FROM (SELECT unnest(list_transform(range(1, least(length(word), 10) + 1), lambda k: word[:k])) AS prefix FROM s WHERE part = 'train') GROUP BY 1),
    a AS (SELECT word, unnest(range(4, least(length(word), 10) + 1)) AS k FROM s WHERE part = 'test' AND length(word) >= 4),
    h AS (SELECT word, k, coalesce(c, 0) AS c FROM a LEFT JOIN seen ON a.word[:k] = prefix),
    e AS (SELECT least, word, min(k) FILTER (WHERE c >= least) AS length FROM h, (VALUES (1), (2), (4), (8)) v(least) GROUP BY 1, 2)
    SELECT least::BIGINT AS least, length, count(*) AS n FROM e GROUP BY 1, 2""")
def early_prefix_audit(spark, sf_dir):
    lex = S.lexicon(_docs(spark, sf_dir)).withColumn("part", T.hash_split(F.col("word"))).cache()
    return A.early_prefix_audit(lex.filter("part = 'train'"), lex.filter("part = 'test'"), [1, 2, 4, 8])


# input buffers, names and sentence context

_KEYS = "ab/@#;., "
_PRESSED = f"""i AS (SELECT event_id, ts, user_id AS key, CASE WHEN event_id % 5 = 0 THEN 'Boundary' WHEN event_id % 23 = 0 THEN 'Reset' WHEN event_id % 7 = 0 THEN 'Backspace' ELSE 'Character' END AS kind,
    substr('{_KEYS}', (event_id * 31 % {len(_KEYS)} + 1)::INT, 1) AS ch FROM events),
    x AS (SELECT *, CASE kind WHEN 'Character' THEN ch WHEN 'Boundary' THEN '!' WHEN 'Backspace' THEN '<' ELSE '?' END AS code FROM i)"""


def _pressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 5 == 0, "Boundary").when(e % 23 == 0, "Reset").when(e % 7 == 0, "Backspace").otherwise("Character")
    ch = F.substring(F.lit(_KEYS), (e * 31 % len(_KEYS) + 1).cast("int"), F.lit(1))
    return S.read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("key"), kind.alias("kind"), ch.alias("ch"))


@_query(f"""WITH {_PRESSED}, h AS (SELECT *, list(code) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM x)
    SELECT key, event_id, trigger FROM (SELECT key, event_id, list_reduce(list_prepend('', coalesce(past, [])), lambda s, c: CASE WHEN c = '<' THEN left(s, greatest(length(s) - 1, 0)) WHEN c IN ('!', '?', ' ') OR length(s) >= 4 THEN '' ELSE s || c END) AS trigger
        FROM h WHERE kind = 'Boundary') WHERE trigger <> ''""")
def trigger_buffers(spark, sf_dir):
    return B.over_table(_pressed(spark, sf_dir), B.TriggerBuffer, longest=4)


@_query(f"""WITH {_PRESSED}, h AS (SELECT *, list(code) OVER (PARTITION BY key ORDER BY ts, event_id) AS past FROM x),
    f AS (SELECT key, event_id, list_reduce(list_prepend('0|', past), lambda s, c: CASE
        WHEN c = '<' AND s[-1:] = '|' THEN s
        WHEN c = '<' THEN (split_part(s, '|', 1)::INT + 1)::VARCHAR || '|' || left(split_part(s, '|', 2), length(split_part(s, '|', 2)) - 1)
        WHEN c = '?' THEN (split_part(s, '|', 1)::INT + 1)::VARCHAR || '|'
        ELSE (split_part(s, '|', 1)::INT + 1)::VARCHAR || '|' || right(split_part(s, '|', 2) || CASE c WHEN '!' THEN ' ' ELSE c END, 12) END) AS s FROM h WHERE kind = 'Boundary')
    SELECT key, event_id, split_part(s, '|', 2) AS context, split_part(s, '|', 1)::BIGINT AS version FROM f""")
def text_contexts(spark, sf_dir):
    return B.over_table(_pressed(spark, sf_dir), B.TextContext, longest=12)


_TTL = 30 * 86_400_000


@_query(f"""WITH k AS (SELECT event_id, user_id AS key, ts, CASE WHEN event_id % 8 = 0 THEN 'Correction' WHEN event_id * 31 % 9 < 4 THEN 'Backspace' ELSE 'Character' END AS kind, event_id * 17 % 2 AS b FROM events),
    c AS (SELECT *, CASE b WHEN 0 THEN 'a' ELSE 'b' END AS ch FROM k),
    n AS (SELECT *, lead(kind, 1) OVER o || lead(kind, 2) OVER o || lead(kind, 3) OVER o || lead(kind, 4) OVER o AS kinds, lead(ch, 3) OVER o || lead(ch, 4) OVER o AS typed, lead(event_id, 4) OVER o AS last, lead(ts, 4) OVER o AS upto
        FROM c WINDOW o AS (PARTITION BY key ORDER BY ts, event_id))
    SELECT key, last AS event_id, event_id AS correction_id, typed AS candidate, 'xy' AS replacement FROM n
    WHERE kind = 'Correction' AND kinds = 'BackspaceBackspaceCharacterCharacter' AND typed = CASE WHEN event_id % 16 = 0 THEN 'ab' ELSE 'ba' END AND epoch_ms(upto) < epoch_ms(ts) + {_TTL}""")
def rejected_corrections(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 8 == 0, "Correction").when(e * 31 % 9 < 4, "Backspace").otherwise("Character")
    ch = F.when(e * 17 % 2 == 0, "a").otherwise("b")
    rows = S.read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("key"), kind.alias("kind"), ch.alias("ch"), F.when(e % 16 == 0, "ab").otherwise("ba").alias("original"), F.lit("xy").alias("replacement"))
    return B.over_table(B.watched(rows), B.RejectionTracker, ttl_ms=_TTL)


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, t AS (SELECT word AS token, reverse(word) AS read FROM counts WHERE n < 5), s AS (SELECT *, unnest(range(1, length(token) + 1)) AS start FROM t),
    x AS (SELECT token, start, unnest(list_transform(range(start, length(token) + 1), lambda e: token[start:e])) AS word FROM s),
    y AS (SELECT token, start, unnest(list_transform(range(start, length(token) + 1), lambda e: read[start:e])) AS word FROM s),
    a AS (SELECT 'forward' AS direction, token, word FROM x UNION ALL SELECT 'backward', token, word FROM y)
    SELECT direction, token, count(*) AS hits, count(DISTINCT word) AS words FROM a JOIN lex USING (word) GROUP BY 1, 2""")
def dictionary_substrings(spark, sf_dir):
    counts = S.english_counts(_docs(spark, sf_dir)).cache()
    rare, lex = counts.filter("n < 5").select(F.col("word").alias("token")), S.ranked_lexicon(counts).cache()
    both = C.dictionary_substrings(rare, lex).withColumn("direction", F.lit("forward")).unionByName(C.dictionary_substrings(rare, lex, backward=True).withColumn("direction", F.lit("backward")))
    return both.groupBy("direction", "token").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("word").alias("words"))


_GAINS = ORACLE_SQL["layout_scores"].split("SELECT word, typed, round(")[0].replace("FROM lex)", "FROM counts WHERE n < 5)", 1)


@_query(rf"""{_GAINS}, z AS (SELECT *, c - o AS gain, length(word) AS m, len(list_filter(range(1, length(word) + 1), lambda i: word[i] = typed[i])) = 0 AS other FROM o WHERE regexp_full_match(typed, '[А-яЁё]+')
        AND length(word) BETWEEN 3 AND 20 AND regexp_matches(word, '[aeiou]') AND NOT regexp_matches(word, '[^aeiouy]{{4}}') AND (length(word) <= 4 OR NOT regexp_matches(word, '[^aeiouy]{{3}}'))),
    y AS (SELECT * FROM z WHERE c >= CASE WHEN m <= 4 THEN 0.70e0 ELSE 0.78e0 END AND CASE WHEN m <= 4 THEN other OR gain >= 0.12e0 ELSE gain >= 0.18e0 AND (o < 0.55e0 OR gain >= 0.25e0) END
        AND (m <= 4 AND other OR c >= 0.80e0 AND gain >= 0.12e0 OR o < 0.50e0 AND c >= 0.78e0 OR gain >= 0.22e0))
    SELECT word, typed, round(greatest(0.73e0, least(0.88e0, 0.70e0 + greatest(0, least(0.22e0, c - 0.60e0)) * 0.45e0 + greatest(0, least(0.45e0, 1 - o)) * 0.18e0 + greatest(0, least(0.35e0, gain)) * 0.22e0
        + CASE WHEN other AND m <= 4 THEN 0.04e0 ELSE 0 END + CASE WHEN m <= 4 THEN 0.03e0 ELSE 0 END)), 6) AS score FROM y""")
def unknown_names(spark, sf_dir):
    names = S.english_counts(_docs(spark, sf_dir)).filter("n < 5").select("word", T.to_russian_layout(F.col("word")).alias("typed"))
    score = T.unknown_name_score(F.col("typed"), F.col("word"), T.russian_plausibility(F.col("typed")), T.english_plausibility(F.col("word")))
    return names.withColumn("score", F.round(score, 6)).filter("score is not null")


@_query(rf"""WITH {_TOKENS}, {_WORDS}, {_COUNTS}, {_LEX}, k AS (SELECT doc_id, pos, CASE WHEN pos % 10 = 3 THEN translate(token, '{_EN}', '{_RU}') ELSE token END AS token FROM tok),
    v AS (SELECT *, coalesce(sum(regexp_full_match(token, '[A-Za-z]+')::INT) OVER o, 0) AS en, coalesce(sum(regexp_full_match(token, '[А-яЁё]+')::INT) OVER o, 0) AS ru FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
    d AS (SELECT *, translate(token, '{_RU}', '{_EN}') AS candidate, CASE WHEN ru >= greatest(en + 2, 2) THEN 'ru' WHEN en >= greatest(ru + 2, 2) THEN 'en' WHEN ru > en AND ru >= 3 THEN 'ru' WHEN en > ru AND en >= 3 THEN 'en' END AS dominant FROM v)
    SELECT doc_id, pos::BIGINT AS pos, candidate, round(greatest(0, least(0.97e0, 0.78e0 + freq * 0.18e0 + 0.12e0)), 6) AS confidence FROM d JOIN lex ON lower(candidate) = word
    WHERE regexp_full_match(token, '[А-яЁё]+') AND (dominant = 'en' OR (en >= 1 AND ru = 0))""")
def context_layout(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    token = F.when(F.col("pos") % 10 == 3, T.to_russian_layout(F.col("token"))).otherwise(F.col("token"))
    found = V.context_layout(S.token_rows(docs).withColumn("token", token), S.lexicon(docs).cache())
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "candidate", F.round("confidence", 6).alias("confidence"))


@_query("""WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type END AS trigger, CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' END AS slang, event_id % 4 = 0 AS cs,
        CASE WHEN event_id % 7 < 3 THEN ['B' || user_id, 'a'] ELSE ['A', 'b' || user_id] END AS apps FROM events),
    k AS (SELECT id, min(id) OVER (PARTITION BY lower(trim(trigger)), slang, cs, list_sort(list_transform(apps, lambda a: lower(a)))) AS first_id FROM s)
    SELECT id, first_id FROM k WHERE id <> first_id""")
def duplicate_snippets(spark, sf_dir):
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    apps = F.when(e % 7 < 3, F.array(F.concat(F.lit("B"), user), F.lit("a"))).otherwise(F.array(F.lit("A"), F.concat(F.lit("b"), user)))
    trigger = F.when(e % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_type")))
    lang = F.when(e % 3 == 0, "en").when(e % 3 == 1, "ru")
    rows = S.read(spark, sf_dir, "events").select(e.alias("id"), trigger.alias("trigger"), lang.alias("slang"), (e % 4 == 0).alias("case_sensitive"), apps.alias("apps_on"), F.array().cast("array<string>").alias("apps_off"))
    return V.duplicate_snippets(rows)


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, t AS (SELECT word, translate(word, '{_EN}', '{_RU}') AS typed FROM lex),
    p AS (SELECT word, typed, unnest(range(0, length(typed) + 1)) AS i FROM t),
    v AS (SELECT word, typed, CASE i WHEN 0 THEN translate(typed, 'еЕ', 'ёЁ') ELSE typed[:i - 1] || translate(typed[i], 'еЕ', 'ёЁ') || typed[i + 1:] END AS variant FROM p
        UNION SELECT word, typed, CASE i WHEN 0 THEN translate(typed, 'ёЁ', 'еЕ') ELSE typed[:i - 1] || translate(typed[i], 'ёЁ', 'еЕ') || typed[i + 1:] END FROM p)
    SELECT word, variant FROM v WHERE variant <> typed""")
def yo_variants(spark, sf_dir):
    return S.lexicon(_docs(spark, sf_dir)).select("word", F.explode(T.yo_variants(T.to_russian_layout(F.col("word")))).alias("variant"))


@_query(r"""WITH t AS (SELECT event_id AS id, event_type || '.exe;' || upper(event_type) || ', a b' || chr(10) || ' x' || (event_id % 3) || '.EXE ,,c:\' || user_id AS text FROM events),
    b AS (SELECT id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[,;\n\r]'), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_replace(x, '\.exe$', '', 'i')) AS bare FROM t),
    k AS (SELECT id, bare, list_filter(bare, lambda x: regexp_full_match(x, '[A-Za-z0-9._-]{1,64}')) AS ok FROM b)
    SELECT id, array_to_string(list_filter(ok, lambda x, i: list_position(list_transform(ok, lambda y: lower(y)), lower(x)) = i), '|') AS names, (len(bare) - len(ok))::INTEGER AS n_errors FROM k""")
def process_names(spark, sf_dir):
    e, kind = F.col("event_id"), F.col("event_type")
    text = F.concat(kind, F.lit(".exe;"), F.upper(kind), F.lit(", a b\n x"), (e % 3).cast("string"), F.lit(".EXE ,,c:\\"), F.col("user_id").cast("string"))
    found = V.process_names(S.read(spark, sf_dir, "events").select(e.alias("id"), text.alias("text")))
    return found.withColumn("names", F.array_join("names", "|"))


@_query(rf"""WITH {_TOKENS}, r AS (SELECT token AS word, CASE pos % 4 WHEN 0 THEN NULL ELSE (pos % 4 - 1) * 0.75e0 END AS freq FROM tok), k AS (SELECT * FROM r WHERE freq IS NULL OR freq BETWEEN 0 AND 1)
    SELECT freq, count(*) AS n FROM k WHERE length(trim(word)) BETWEEN 1 AND 256 AND NOT regexp_matches(trim(word), '[\x00-\x1F\x7F]') GROUP BY 1""")
def valid_entries(spark, sf_dir):
    pos = F.col("pos") % 4
    rows = S.token_rows(_docs(spark, sf_dir)).select(F.col("token").alias("word"), F.when(pos == 0, F.lit(None)).otherwise((pos - 1) * F.lit(0.75)).cast("double").alias("freq"))
    return V.valid_entries(rows).groupBy("freq").agg(F.count(F.lit(1)).alias("n"))


# lookups and guards

_SERVICE = ", ".join("('" + k.replace("'", "''") + f"', '{v}', 'ru')" for k, v in K.SERVICE_WORDS_RU.items()) + ", " + ", ".join(f"('{k}', '{v}', 'en')" for k, v in K.SERVICE_WORDS_EN.items())
_KEYED = f"k AS (SELECT token FROM t UNION SELECT translate(token, '{_EN}', '{_RU}') FROM t UNION SELECT translate(token, '{_RU}', '{_EN}') FROM t)"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tokens, as they are and as the other layout's keys would have given them."""
    t = F.col("token")
    return _distinct_tokens(spark, sf_dir).select(F.explode(F.array(t, T.to_russian_layout(t), T.to_english_layout(t))).alias("token")).distinct()


@_query(rf"""WITH {_TOKENS}, {_DISTINCT}, {_KEYED}, l AS (SELECT token, regexp_replace(token, '[^\p{{L}}]', '', 'g') AS s FROM k)
    SELECT token, CASE WHEN regexp_full_match(s, '[A-Za-z]+') THEN 'en' WHEN regexp_full_match(s, '[А-яЁё]+') THEN 'ru' END AS lang FROM l""")
def token_languages(spark, sf_dir):
    return _keyed(spark, sf_dir).select("token", K.token_language(F.col("token")).alias("lang"))


@_query(rf"""WITH {_TOKENS}, {_DISTINCT}, {_KEYED}, s(low, word, target) AS (VALUES {_SERVICE})
    SELECT token, CASE WHEN NOT regexp_matches(token, '^\p{{Lu}}') THEN word WHEN target = 'ru' THEN upper(word[1]) || word[2:] ELSE upper(word) END AS word, target FROM k JOIN s ON lower(token) = low
    WHERE NOT (length(token) > 1 AND regexp_full_match(token, '\p{{Lu}}+'))""")
def service_words(spark, sf_dir):
    found = _keyed(spark, sf_dir).select("token", K.service_word(F.col("token")).alias("s")).filter("s is not null")
    return found.select("token", "s.word", "s.target")


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, {_RARE}, c AS (SELECT DISTINCT token, token[:i - 1] || token[i + 1:] AS word FROM (SELECT token, unnest(range(1, length(token))) AS i FROM rare) WHERE token[i] = token[i + 1])
    SELECT token, min(c.word) AS word FROM c JOIN long ON c.word = long.word AND freq >= 0.65e0 GROUP BY 1 HAVING count(*) = 1""")
def repeated_letter_targets(spark, sf_dir):
    return K.repeated_letter_targets(*_rare_and_lexicon(spark, sf_dir))


@_query(f"""{_BASE}, m AS (SELECT *, min(cost) OVER (PARTITION BY token) AS least FROM src)
    SELECT token, word FROM m WHERE freq >= 0.65e0 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.token = m.token AND o.word <> m.word AND o.cost <= o.least + 0.01e0 AND o.freq >= m.freq - 0.12e0)
    AND (NOT EXISTS (SELECT 1 FROM m o WHERE o.token = m.token AND o.word <> m.word AND o.cost <= o.least + 0.08e0 AND NOT m.freq >= o.freq + 0.12e0)
        OR (m.freq >= 0.995e0 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.token = m.token AND o.word <> m.word AND o.cost <= o.least + 0.08e0 AND NOT o.freq <= m.freq - 0.004e0)))""")
def clear_substitutions(spark, sf_dir):
    return K.clear_substitutions(_sources(spark, sf_dir))


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, s AS (SELECT word, translate(word, '{_EN}', '{_RU}') AS typed, freq, length(word) AS n, {_PLAUSIBLE.format("word")}::DOUBLE AS p FROM lex WHERE length(word) <= 4),
    v AS (SELECT *, length(regexp_replace(typed, '[^аеёиоуыэюя]', '', 'g')) AS nv, list_max(list_transform(regexp_split_to_array(regexp_replace(typed, '[^аеёиоуыэюябвгджзйклмнпрстфхцчшщъь]', '', 'g'), '[аеёиоуыэюя]'), lambda r: length(r))) AS run FROM s),
    o AS (SELECT *, CASE WHEN n = 1 THEN CASE WHEN nv = 1 THEN 0.45e0 ELSE 0.25e0 END WHEN nv = 0 THEN 0.12e0 ELSE greatest(0.0e0, least(1.0e0, 0.72e0 + CASE WHEN n >= 3 THEN 0.08e0 ELSE 0 END
        + CASE WHEN nv / n BETWEEN 0.25e0 AND 0.60e0 THEN 0.05e0 WHEN nv / n < 0.25e0 THEN -0.16e0 ELSE 0 END + CASE WHEN run > 3 THEN -0.22e0 WHEN run = 3 THEN -0.10e0 ELSE 0 END)) END::DOUBLE AS q FROM v)
    SELECT word, typed, CASE WHEN n = 1 THEN freq >= 0.85e0 AND round(p - q, 9) >= 0.15e0 WHEN n = 2 THEN freq >= 0.90e0 OR (freq >= 0.75e0 AND round(p - q, 9) >= 0.12e0) ELSE freq >= 0.70e0 END AS alone,
        CASE WHEN n = 1 THEN freq >= 0.85e0 AND round(p - q, 9) >= 0.15e0 WHEN n = 2 THEN freq >= 0.90e0 OR (freq >= 0.75e0 AND round(p - q, 9) >= 0.12e0) ELSE freq >= 0.55e0 END AS in_context FROM o""")
def short_layout_policy(spark, sf_dir):
    lex = S.lexicon(_docs(spark, sf_dir)).filter("length(word) <= 4").select("word", "freq", T.to_russian_layout(F.col("word")).alias("typed"))
    allowed = lambda c: K.allows_short_layout(F.col("typed"), F.col("freq"), F.lit(0.0), F.round(T.english_plausibility(F.col("word")) - T.russian_plausibility(F.col("typed")), 9), F.lit(c))
    return lex.select("word", "typed", allowed(False).alias("alone"), allowed(True).alias("in_context"))


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, p AS (SELECT a.word AS word, b.word AS other FROM lex a JOIN lex b ON a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1
        AND CASE WHEN length(a.word) = length(b.word) THEN hamming(a.word, b.word) <= 2 ELSE levenshtein(a.word, b.word) = 1 END)
    SELECT word, count(*) AS n FROM p JOIN (SELECT word AS w FROM lex) ON w = other WHERE levenshtein(word, other) = 1 OR damerau_levenshtein(word, other) = 1 GROUP BY 1""")
def known_word_guards(spark, sf_dir):
    lex = S.lexicon(_docs(spark, sf_dir)).select("word", "freq").cache()
    pairs = C.one_edit_pairs(lex.select(F.col("word").alias("token")), lex)
    blocked = K.blocks_known_to_known(F.col("token"), F.col("word"), F.lit(True), F.lit(True))
    return pairs.filter(blocked).groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("n"))


# early layout: English words, and French ones as typed on the Russian layout

_MARGINS = [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 7.0]
_NAMES = ", ".join(f"'{x.lower()}'" for x in T.TECHNICAL_NAMES)
_LP = " - ".join(
    f"""ln((coalesce((SELECT sum(weight) FROM g WHERE lang = '{x}' AND gram = u.gram), 0) + 2 * (coalesce((SELECT sum(weight) FROM g WHERE lang = '{x}' AND gram[2:] = u.gram[2:]), 0)
        + 2 * (coalesce((SELECT sum(weight) FROM g WHERE lang = '{x}' AND gram[3:] = u.gram[3:]), 0) + 0.1e0) / ((SELECT sum(weight) FROM g WHERE lang = '{x}') + 3.4e0))
        / (coalesce((SELECT sum(weight) FROM g WHERE lang = '{x}' AND gram[2] = u.gram[2]), 0) + 2)) / (coalesce((SELECT sum(weight) FROM g WHERE lang = '{x}' AND gram[:2] = u.gram[:2]), 0) + 2))"""
    for x in ("ru", "en")
)
_EARLY = f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, {_COUNTS.replace("counts AS", "fcounts AS").replace("'en'", "'fr'")}, {_LEX.replace("lex AS", "flex AS").replace("FROM counts", "FROM fcounts")},
    named AS (SELECT 'en' AS lang, word AS keys, word, freq * freq AS weight FROM lex UNION ALL SELECT 'ru', word, translate(word, '{_EN}', '{_RU}'), freq * freq FROM flex),
    parted AS (SELECT *, {_SPLIT} AS part FROM named), tr AS (SELECT * FROM parted WHERE part = 'train'),
    pre AS (SELECT p, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'ru') AS ru FROM (SELECT lang, unnest(list_transform(range(1, least(length(keys), 10) + 1), lambda k: keys[:k])) AS p FROM tr) GROUP BY 1),
    g AS (SELECT lang, gram, sum(weight) AS weight FROM (SELECT lang, weight, unnest(list_transform(range(1, length(keys) + 1), lambda i: ('^^' || keys)[i:i + 2])) AS gram FROM tr) GROUP BY 1, 2),
    q AS (SELECT lang, word, keys, k, typed, keys[:k] AS p FROM (SELECT *, unnest(range(4, least(length(keys), 10) + 1)) AS k FROM parted WHERE part = 'PART' AND length(keys) >= 4), (VALUES ('en'), ('ru')) v(typed)),
    o AS (SELECT q.* FROM q JOIN pre ON q.p = pre.p WHERE CASE typed WHEN 'en' THEN pre.en = 0 AND pre.ru >= 1 AND q.p NOT IN ({_NAMES}) ELSE pre.ru = 0 AND pre.en >= 1 END),
    d AS (SELECT p, unnest(list_transform(range(1, length(p) + 1), lambda i: ('^^' || p)[i:i + 2])) AS gram FROM (SELECT DISTINCT p FROM o)),
    u AS (SELECT DISTINCT gram FROM d), lp AS (SELECT gram, {_LP} AS gain FROM u), gains AS (SELECT p, avg(gain) AS gain FROM d JOIN lp USING (gram) GROUP BY 1),
    open AS (SELECT o.*, CASE typed WHEN 'en' THEN gain ELSE -gain END AS margin FROM o JOIN gains USING (p)),
    each AS (SELECT m.margin, q.lang, q.word, count(*) FILTER (WHERE q.typed = q.lang) AS positions, bool_or(q.typed = q.lang AND coalesce(open.margin >= m.margin, false)) AS wrongly,
        min(q.k) FILTER (WHERE q.typed <> q.lang AND open.margin >= m.margin) AS k, any_value(length(q.keys)) AS l
        FROM q LEFT JOIN open ON q.lang = open.lang AND q.word = open.word AND q.k = open.k AND q.typed = open.typed, (VALUES {", ".join(f"({m}e0)" for m in _MARGINS)}) m(margin) GROUP BY 1, 2, 3)"""


def _early(spark: SparkSession, sf_dir: str) -> tuple[Y.EarlyModel, DataFrame]:
    """The model of the training words, and all words with their part."""
    docs = _docs(spark, sf_dir)
    english = S.lexicon(docs).select(F.lit("en").alias("lang"), "word", "freq")
    french = S.ranked_lexicon(S.ascii_counts(docs, "fr")).select(F.lit("ru").alias("lang"), T.to_russian_layout(F.col("word")).alias("word"), "freq")
    words = english.unionByName(french).withColumn("part", T.hash_split(F.col("word"))).cache()
    return Y.train(words.filter("part = 'train'").withColumn("weight", F.col("freq") * F.col("freq"))), words


@_query(_EARLY.replace("PART", "test") + """ SELECT margin::DOUBLE AS margin, lang, count(*) AS eligible, sum(positions)::BIGINT AS positions, count(*) FILTER (WHERE wrongly) AS false_switches,
    count(k) AS recovered, count(*) FILTER (WHERE k IS NULL) AS missed, count(*) FILTER (WHERE k < l) AS before_end FROM each GROUP BY 1, 2""")
def early_layout_audit(spark, sf_dir):
    model, words = _early(spark, sf_dir)
    return Y.switch_audit(words.filter("part = 'test'"), model, _MARGINS)


@_query(_EARLY.replace("PART", "valid") + """, f AS (SELECT margin, count(*) FILTER (WHERE wrongly) AS n FROM each GROUP BY 1)
    SELECT coalesce(min(margin) FILTER (WHERE n = 0), max(margin))::DOUBLE AS margin, min(margin) FILTER (WHERE n = 0) IS NOT NULL AS safe FROM f""")
def early_layout_threshold(spark, sf_dir):
    model, words = _early(spark, sf_dir)
    return Y.safe_margin(Y.switch_audit(words.filter("part = 'valid'"), model, _MARGINS))


@_query(_EARLY.replace("PART", "test") + f""", f AS (SELECT lang, word, keys, min(k) AS length FROM open WHERE typed <> lang AND margin >= 1.25e0 GROUP BY ALL)
    SELECT CASE lang WHEN 'en' THEN 'ru' ELSE 'en' END AS lang, CASE lang WHEN 'en' THEN translate(word, '{_EN}', '{_RU}') ELSE keys END AS word, length, word[:length] AS switched FROM f""")
def early_layout_switches(spark, sf_dir):
    model, words = _early(spark, sf_dir)
    test, flipped = words.filter("part = 'test'"), F.when(F.col("lang") == "en", "ru").otherwise("en")
    typed = test.select(flipped.alias("lang"), Y.other_layout(F.col("word"), F.col("lang")).alias("word"))
    return Y.session_switches(typed, model).withColumn("length", F.col("length").cast("long"))


@_query(rf"""WITH {_WORDS}, {_COUNTS}, {_LEX}, {_TOKENS}, {_DISTINCT}, low AS (SELECT token, lower(trim(token)) AS key FROM t),
    u AS (SELECT 'user' || user_id AS word, CASE WHEN user_id % 3 > 0 THEN (user_id % 3) * 0.25e0 END AS freq FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT word, 0.5e0 FROM lex WHERE rank % 10 = 0),
    forms AS (SELECT word || 's' AS word, word AS root FROM counts WHERE n < 50),
    uu AS (SELECT lower(trim(word)) AS key, max(coalesce(freq, 0.75e0)) AS f FROM u GROUP BY 1),
    ff AS (SELECT forms.word AS key, max(CASE WHEN lex.freq IS NULL THEN 0.68e0 ELSE greatest(0.68e0, least(0.90e0, lex.freq * 0.82e0)) END) AS f FROM forms LEFT JOIN lex ON root = lex.word GROUP BY 1),
    safe AS (SELECT token, CASE WHEN regexp_full_match(token, '[A-Za-z]+') AND NOT regexp_matches(token, '\p{{Ll}}.*\p{{Lu}}') AND lower(token) NOT IN ({_NAMES}) THEN key END AS key FROM low WHERE regexp_full_match(token, '[A-Za-z]+'))
    SELECT CASE WHEN uu.f IS NOT NULL THEN 'user' WHEN lex.freq IS NOT NULL THEN 'lexicon' WHEN ff.f IS NOT NULL THEN 'form' END AS origin, count(*) AS n, round(sum(coalesce(uu.f, lex.freq, ff.f, 0)), 6) AS total
    FROM safe LEFT JOIN uu ON safe.key = uu.key LEFT JOIN lex ON safe.key = lex.word LEFT JOIN ff ON safe.key = ff.key GROUP BY 1""")
def dictionary_chain(spark, sf_dir):
    docs, en, none = _docs(spark, sf_dir), F.lit("en").alias("lang"), F.lit(None).cast("double")
    counts = S.english_counts(docs)
    lex = S.ranked_lexicon(counts).select("word", en, "freq", "rank")
    u = F.col("user_id")
    users = S.read(spark, sf_dir, "events").select(u).distinct().select(F.concat(F.lit("user"), u.cast("string")).alias("word"), en, F.when(u % 3 > 0, (u % 3) * 0.25).otherwise(none).alias("freq"))
    users = users.unionByName(lex.filter("rank % 10 = 0").select("word", "lang", F.lit(0.5).alias("freq")))
    forms = counts.filter("n < 50").select(F.concat("word", F.lit("s")).alias("word"), en, F.col("word").alias("root"))
    words = _distinct_tokens(spark, sf_dir).filter(F.col("token").rlike("^[A-Za-z]+$")).select(F.col("token").alias("word"), en)
    return K.dictionary_frequencies(words, users, lex, forms).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("freq"), 6).alias("total"))


# families of generated words, scores of candidates, anchors, outside scorers

_CONFUSED = ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in E.CONFUSED)
_BESIDE = ", ".join(f"('{k}', '{c}')" for k, v in E.key_neighbours().items() for c in v)


@_query(f"""WITH {_WORDS}, {_COUNTS}, {_LEX}, nb(key, c) AS (VALUES {_BESIDE}), cf(was, now) AS (VALUES {_CONFUSED}), vw(v) AS (VALUES ('a'), ('e'), ('i'), ('o'), ('u'), ('y')),
    t AS (SELECT word, length(word) AS n, translate(word, '{_EN}', '{_RU}') AS typed FROM lex), i0 AS (SELECT *, unnest(range(0, n + 1)) AS i FROM t),
    made AS (SELECT word, 'repeated' AS family, word[:i] || word[i:] AS made FROM i0 WHERE i >= 1
        UNION SELECT word, 'neighbour', left(word, i) || c || word[i + 1:] FROM i0 JOIN nb ON (i >= 1 AND key = word[i]) OR key = word[i + 1]
        UNION SELECT word, 'vowel', word[:i] || v || word[i + 1:] FROM i0, vw WHERE i BETWEEN 1 AND n - 1 AND strpos('aeiouy', word[i]) = 0 AND strpos('aeiouy', word[i + 1]) = 0
        UNION SELECT word, 'confusion', left(typed, i - 1) || now || typed[i + 1:] FROM i0 JOIN cf ON i >= 1 AND was = typed[i])
    SELECT word, family, count(*) AS n, min(made) AS least, max(made) AS most FROM made GROUP BY 1, 2""")
def generator_families(spark, sf_dir):
    w = F.col("word")
    made = {"repeated": E.repeated_insertions(w), "neighbour": E.neighbour_insertions(w), "vowel": E.vowel_insertions(w), "confusion": E.vowel_confusions(T.to_russian_layout(w))}
    rows = S.lexicon(_docs(spark, sf_dir)).select("word", F.explode(F.array(*[F.struct(F.lit(k).alias("family"), v.alias("made")) for k, v in made.items()])).alias("f"))
    return rows.filter(F.size("f.made") > 0).select("word", "f.family", F.size("f.made").cast("long").alias("n"), F.array_min("f.made").alias("least"), F.array_max("f.made").alias("most"))


@_query(f"""{_BASE}, p AS (SELECT *, length(token) AS nt, length(word) AS nw, {_PLAUSIBLE.format("token")}::DOUBLE AS po, {_PLAUSIBLE.format("word")}::DOUBLE AS pc FROM src),
    i AS (SELECT *, CASE WHEN round(pc - po, 9) > 0.01e0 THEN round(pc - po, 9) ELSE 0.10e0 END AS gain,
        len(list_filter(range(1, nw), lambda k: word[k] = word[k + 1] AND left(word, k - 1) || word[k + 1:] = token)) > 0 AS doubled FROM p),
    b AS (SELECT *, 0.22e0 * CASE WHEN operation = 'AdjacentKeySubstitution' THEN least(1.0e0, greatest(0.2e0, 1 - cost * 0.5e0) + 0.06e0) ELSE greatest(0.2e0, 1 - cost * 0.5e0) END + 0.26e0 * pc + 0.26e0 * least(0.55e0, gain)
        + least(0.22e0, freq * 0.22e0) + 0.14e0 + CASE WHEN gain >= 0.18e0 THEN 0.05e0 ELSE 0 END + CASE WHEN cost <= 0.76e0 AND nt = nw THEN 0.06e0 ELSE 0 END + CASE WHEN cost <= 0.76e0 AND freq >= 0.9e0 THEN 0.04e0 ELSE 0 END
        + CASE WHEN operation = 'AdjacentTransposition' THEN 0.07e0 ELSE 0 END + CASE WHEN doubled THEN 0.10e0 ELSE 0 END AS s FROM i),
    r AS (SELECT *, CASE WHEN operation = 'RepeatedAccidentalCharacter' THEN s + 0.22e0 + CASE WHEN freq >= 0.7e0 THEN 0.06e0 ELSE 0 END WHEN nw = nt - 1 THEN CASE WHEN freq < 0.93e0 OR nt <= 4 THEN 0 ELSE s * 0.78e0 END ELSE s END AS x FROM b),
    z AS (SELECT token, word, freq, cost, round(greatest(0.0e0, least(0.95e0, x * CASE WHEN nt = 3 THEN 0.88e0 ELSE 1.0e0 END)), 9)::DOUBLE AS score FROM r)
    SELECT token, word, score, count(*) OVER (PARTITION BY token) AS n FROM z WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY token ORDER BY score DESC, freq DESC, cost, word) = 1""")
def candidate_scores(spark, sf_dir):
    token, word, no = F.col("token"), F.col("word"), F.lit(False)
    score = L.candidate_score(token, word, F.col("cost"), F.col("freq"), T.english_plausibility(token), T.english_plausibility(word), F.col("operation") == G.ADJACENT, no, no, F.lit(0.0))
    scored = _sources(spark, sf_dir).select("token", "word", "cost", "freq", F.lit(2).alias("tier"), score.alias("score"))
    return L.best_candidates(scored)


_ANCHORS, _TECHNICAL = (", ".join(f"'{x}'" for x in v) for v in (K.LAYOUT_ANCHORS, K.TECHNICAL_WORDS))


@_query(rf"""WITH {_TOKENS}, {_DISTINCT}, {_KEYED} SELECT lower(token) IN ({_ANCHORS}) AS anchor, lower(token) IN ({_TECHNICAL}) AS technical, CASE lower(token) WHEN 'ррудщ' THEN 'hello' END AS alias, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def layout_anchors(spark, sf_dir):
    t = F.col("token")
    return _keyed(spark, sf_dir).groupBy(K.is_layout_anchor(t).alias("anchor"), K.is_technical_word(t).alias("technical"), K.anchor_alias(t).alias("alias")).agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT event_id AS id FROM events WHERE event_id % 3 = 1 AND event_id % 7 > 0 AND 0.96e0 + (event_id % 5) * 0.01e0 >= 0.98e0 AND (event_id % 4) * 0.1e0 >= 0.2e0
    AND (event_id % 2 = 0 OR (event_id % 10) / 10.0e0 >= 0.7e0)""")
def scorer_promotions(spark, sf_dir):
    e = F.col("event_id")
    core = F.when(e % 3 == 0, "apply").when(e % 3 == 1, "wait").otherwise("no_change")
    word = F.when(e % 7 == 0, F.upper("event_type")).otherwise(F.concat("event_type", F.lit("x")))
    kind = F.when(e % 2 == 0, "layout").otherwise("spelling")
    promoted = G.promotes_scorer(F.col("event_type"), word, core, kind, 0.96 + (e % 5) * F.lit(0.01), (e % 4) * F.lit(0.1), (e % 10) / F.lit(10.0), F.lit(True), F.lit(True))
    return S.read(spark, sf_dir, "events").filter(promoted).select(e.alias("id"))
