"""Exact lookups and guards over tokens and a lexicon: common slips, service words, anchors, known words, short tokens."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import edits as E
from lexiloom.functions import text as T
from lexiloom.operators import candidates as C

# fixed values: slips and the words they stand for
COMMON_SLIPS = {
    "en": {"teh": "the", "adn": "and", "helo": "hello"},
    "ru": {"кмнда": "команда", "пжлуста": "пожалуйста", "пжлст": "пожалуйста", "пожалста": "пожалуйста", "спсибо": "спасибо"},
}
# fixed values: short words typed on the other layout, by what the keys gave
SERVICE_WORDS_RU = {
    "z": "я", "f": "а", "d": "в", "b": "и", "c": "с", "r": "к", "j": "о", "e": "у", "ns": "ты", "vs": "мы", "jy": "он", "jyf": "она", "yt": "не", "yf": "на", "gj": "по", "pf": "за", "jn": "от",
    "lj": "до", "bp": "из", "'nj": "это", "nen": "тут", "rfr": "как", "jyb": "они", "jyj": "оно", "xnj": "что", "t;br": "ежик", "rjn": "кот", "xvj": "чмо", "jgf": "опа", "ldf": "два", "nhb": "три",
    "[jnm": "хоть", "vtyz": "меня",
}
SERVICE_WORDS_EN = {
    "ф": "a", "ш": "i", "ру": "he", "ьу": "me", "ьн": "my", "црщ": "who", "шеы": "its", "ше": "it", "дуфл": "leak", "сфк": "car", "рше": "hit", "рще": "hot", "рщу": "hoe", "рун": "hey",
}
# fixed values: tokens that are surely typed on the other layout, one of them with a repeated key, and technical words
LAYOUT_ANCHORS = (
    "ghbdtn", "руддщ", "ррудщ", "dct", "jrtq", "nen", "vbyzq", "vtyzq", "gtie", "gbie", "мущ", "пзг", "dhjlt", "lfq", "rjvfyle", "pfgecrf", "ybxtuj", "рш", "цфше", "цщкл", "вуфк",
)
ANCHOR_ALIASES = {"ррудщ": "hello"}
TECHNICAL_WORDS = ("api", "cli", "ui", "ux", "fast", "http", "https", "json", "xml", "sql", "bash", "shell", "docker", "github", "gpu", "ram", "ssd", "cpu")
#: Confidence of a service word.
SERVICE_CONFIDENCE = 0.91
_REPEATED = 0.65


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def slip_map(language: str) -> Column:
    """The common slips of a language and their words."""
    return _map(COMMON_SLIPS[language])


def token_language(token: Column) -> Column:
    """en or ru by the letters of the token alone; null if they are of both scripts, of others, or if there are none."""
    kind = T.script(F.regexp_replace(token, r"[^\p{L}]", ""))
    return F.when(kind == "Latin", "en").when(kind == "Cyrillic", "ru")


def common_slips(tokens: DataFrame, lexicon: DataFrame, language: str = "en") -> DataFrame:
    """token, word: tokens that are a common slip of the language whose word the lexicon has."""
    found = tokens.select("token", F.try_element_at(slip_map(language), F.lower("token")).alias("word")).filter("word is not null")
    return found.join(lexicon.select("word"), "word", "left_semi").select("token", "word")


def service_word(token: Column) -> Column:
    """(word, target) of a short word typed on the other layout, null for any other token. Longer tokens in capitals are abbreviations;
    a capital first letter is kept (English words are given in capitals then, as they have one letter or stand for pronouns)."""
    low = F.lower(token)
    shouted = (F.length(token) > 1) & token.rlike(r"^\p{Lu}+$")
    first = token.rlike(r"^\p{Lu}")
    ru, en = F.try_element_at(_map(SERVICE_WORDS_RU), low), F.try_element_at(_map(SERVICE_WORDS_EN), low)
    ru = F.when(T.script_for_layout(token) == "Latin", F.when(first, F.concat(F.upper(F.substring(ru, 1, 1)), ru.substr(F.lit(2), F.length(ru)))).otherwise(ru))
    en = F.when(T.script(token) == "Cyrillic", F.when(first, F.upper(en)).otherwise(en))
    word = F.when(~shouted, F.coalesce(ru, en))
    return F.when(word.isNotNull(), F.struct(word.alias("word"), F.when(ru.isNotNull(), "ru").otherwise("en").alias("target")))


def is_layout_anchor(token: Column) -> Column:
    return F.coalesce(F.lower(token).isin(*LAYOUT_ANCHORS), F.lit(False))


def anchor_alias(token: Column) -> Column:
    """The word of an anchor with a repeated key; null for any other token."""
    return F.try_element_at(_map(ANCHOR_ALIASES), F.lower(token))


def is_technical_word(token: Column) -> Column:
    return F.coalesce(F.lower(token).isin(*TECHNICAL_WORDS), F.lit(False))


def blocks_layout(token: Column, known: Column) -> Column:
    """Whether a Latin token stays as it is because it is blank or a known English word that is no service word of the other layout."""
    blank = F.coalesce(F.trim(token) == "", F.lit(True))
    return blank | ((T.script(token) == "Latin") & service_word(token).isNull() & known)


def blocks_known_to_known(original: Column, candidate: Column, known_original: Column, known_candidate: Column) -> Column:
    """Whether a known word stays as it is because the candidate is a known word near it: of the same length with one or two other
    letters, or one letter longer or shorter, whose other letters are the same in order."""
    a, b = T.lookup_key(original), T.lookup_key(candidate)
    na, nb = F.length(a), F.length(b)
    places = F.sequence(F.lit(1), F.greatest(na, F.lit(1)))
    other = F.size(F.filter(places, lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1))))
    near = F.when(na == nb, other.between(1, 2)).when(na == nb + 1, F.array_contains(E.deletions(a), b)).when(nb == na + 1, F.array_contains(E.deletions(b), a)).otherwise(False)
    return known_original & known_candidate & near


def repeated_letter_targets(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """token, word: the word that a token becomes by taking one letter of a doubled pair away, if it is the only one of frequency 0.65."""
    cut = tokens.select("token", F.explode(F.array_distinct(E.repeat_cleanups(F.col("token")))).alias("word"))
    found = cut.join(C.sized(lexicon.filter(F.col("freq") >= _REPEATED).select("word")), "word")
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("word")).filter("n = 1").select("token", "word")


def clear_substitutions(sources: DataFrame) -> DataFrame:
    """token, word of sources (token, word, cost, freq) that may be applied as a substitution: frequency from 0.65, no other source of least
    cost (0.01) within 0.12 below its frequency, and 0.12 above every other one of cost up to 0.08 above the least, or from
    0.995 and 0.004 above these."""
    rows = F.struct("word", "cost", "freq")
    one = Window.partitionBy("token")
    near = sources.withColumn("least", F.min("cost").over(one)).filter(F.col("cost") <= F.col("least") + 0.08).groupBy("token").agg(F.collect_list(rows).alias("near"), F.min("cost").alias("least"))
    t = sources.filter(F.col("freq") >= 0.65).join(near, "token")
    others = F.filter("near", lambda s: s["word"] != F.col("word"))
    peer = F.exists(others, lambda s: (s["cost"] <= F.col("least") + 0.01) & (s["freq"] >= F.col("freq") - 0.12))
    ahead = F.forall(others, lambda s: F.col("freq") >= s["freq"] + 0.12)
    far = (F.col("freq") >= 0.995) & F.forall(others, lambda s: s["freq"] <= F.col("freq") - 0.004)
    return t.filter(~peer & (ahead | far)).select("token", "word")


def allows_short_layout(token: Column, freq: Column, p_token: Column, p_target: Column, in_context: Column) -> Column:
    """Whether a token of one to four keys may become the target of frequency ``freq`` on the other layout, by its length, the gain in
    plausibility, and whether the sentence is in the target's language."""
    gain, n = p_target - p_token, F.length(token)
    return (
        F.when(n == 1, (freq >= 0.85) & (gain >= 0.15))
        .when(n == 2, (freq >= 0.90) | ((freq >= 0.75) & (gain >= 0.12)))
        .when(n.isin(3, 4), (freq >= 0.70) | ((freq >= 0.55) & in_context))
        .otherwise(False)
    )


# fixed values: frequency of a user's own word without one, the discount and bounds of a form by its root, a form without a known root
USER_FREQ, FORM_DISCOUNT, FORM_LEAST, FORM_MOST = 0.75, 0.82, 0.68, 0.90


def dictionary_frequencies(words: DataFrame, users: DataFrame, lexicon: DataFrame, forms: DataFrame) -> DataFrame:
    """word, lang, freq, origin of the distinct ``words(word, lang)``, by the first dictionary that has the lookup key in that language:
    ``users(word, lang, freq)`` (0.75 without a frequency), ``lexicon(word, lang, freq)``, ``forms(word, lang, root)``, whose frequency follows
    from the root's in the lexicon. Unknown and protected words have 0 and no origin. Of rows with one key, the greatest frequency counts."""

    def table(df: DataFrame, value: Column, name: str) -> DataFrame:
        return C.sized(df.select(T.lookup_key(F.col("word")).alias("key"), "lang", value.alias(name)).groupBy("key", "lang").agg(F.max(name).alias(name)))

    user = table(users, F.coalesce(F.col("freq"), F.lit(USER_FREQ)), "user")
    lex = table(lexicon, F.col("freq"), "lex")
    rooted = forms.select("word", "lang", T.lookup_key(F.col("root")).alias("key")).join(lex, ["key", "lang"], "left")
    by_root = F.greatest(F.lit(FORM_LEAST), F.least(F.lit(FORM_MOST), F.col("lex") * FORM_DISCOUNT))
    form = table(rooted, F.coalesce(F.when(F.col("lex").isNotNull(), by_root), F.lit(FORM_LEAST)), "form")
    rows = words.select("word", "lang").distinct().withColumn("key", F.when(~T.is_protected(F.col("word")), T.lookup_key(F.col("word"))))
    for dictionary in (user, lex, form):
        rows = rows.join(dictionary, ["key", "lang"], "left")
    origin = F.when(F.col("user").isNotNull(), "user").when(F.col("lex").isNotNull(), "lexicon").when(F.col("form").isNotNull(), "form")
    return rows.select("word", "lang", F.coalesce("user", "lex", "form", F.lit(0.0)).alias("freq"), origin.alias("origin"))
