"""Scalar functions over token columns; every one is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the two keyboard layouts, key by key
EN_KEYS = "`qwertyuiop[]asdfghjkl;'zxcvbnm,./\\~@#$^&:\"<>?" + "QWERTYUIOPASDFGHJKLZXCVBNM"
RU_KEYS = "ёйцукенгшщзхъфывапролджэячсмитьбю./Ё\"№;:?ЖЭБЮ," + "ЙЦУКЕНГШЩЗФЫВАПРОЛДЯЧСМИТЬ"
# fixed values: names that are never corrected
TECHNICAL_NAMES = (
    "Cursor", "GitHub", "GitLab", "VSCode", "VS", "Code", "Microsoft", "Windows", "Linux", "Docker", "npm", "Node", "React", "Angular", "Vue", "Python",
    "JavaScript", "TypeScript", "StackOverflow", "IntelliJ", "JetBrains", "Avalonia", "dotnet", "NuGet", "PowerShell",
)
LETTERS = r"\p{L}+"


def words(text: Column) -> Column:
    """Maximal runs of letters, in order."""
    return F.regexp_extract_all(text, F.lit(f"({LETTERS})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LETTERS))


def trailing_word(text: Column) -> Column:
    return F.regexp_extract(text, r"(\p{L}+)[^\p{L}]*$", 1)


def ends_sentence(text: Column) -> Column:
    return F.rtrim(text).rlike(r"[.!?]$")


def ends_clause(text: Column) -> Column:
    return F.rtrim(text).rlike(r"[,;:]$")


def lookup_key(word: Column) -> Column:
    return F.lower(F.trim(word))


def rank_frequency(rank: Column, count: Column) -> Column:
    """1 for the first of ``count`` ranks, falling in a line to 0.35."""
    return F.greatest(F.lit(0.35), F.least(F.lit(1.0), 1 - 0.65 * (rank - 1) / F.greatest(F.lit(1), count - 1)))


def to_russian_layout(s: Column) -> Column:
    return F.translate(s, EN_KEYS, RU_KEYS)


def to_english_layout(s: Column) -> Column:
    return F.translate(s, RU_KEYS, EN_KEYS)


def script(token: Column) -> Column:
    """Empty, Latin, Cyrillic, Mixed or Other: only ASCII Latin and Russian letters count as letters."""
    return (
        F.when(F.coalesce(token, F.lit("")) == "", "Empty")
        .when(token.rlike("^[A-Za-z]+$"), "Latin")
        .when(token.rlike("^[А-яЁё]+$"), "Cyrillic")
        .when(token.rlike("^[A-Za-zА-яЁё]+$"), "Mixed")
        .otherwise("Other")
    )


def script_for_layout(token: Column) -> Column:
    """As script, but keys that carry letters on the other layout count as Latin beside a Latin letter."""
    return F.when((script(token) == "Other") & token.rlike(r"""^[A-Za-z`~\[\];:'",.<>]+$""") & token.rlike("[A-Za-z]"), "Latin").otherwise(script(token))


def _plausibility(token: Column, vowels: str, consonants: str) -> Column:
    n = F.length(token)
    v = F.length(F.regexp_replace(token, f"[^{vowels}]", ""))
    # characters that are neither do not end a run
    runs = F.split(F.regexp_replace(token, f"[^{vowels}{consonants}]", ""), f"[{vowels}]")
    longest = F.array_max(F.transform(runs, F.length))
    ratio = v / n
    score = (
        F.lit(0.72)
        + F.when(n >= 3, 0.08).otherwise(0.0)
        + F.when(n >= 5, 0.05).otherwise(0.0)
        + F.when(ratio.between(0.25, 0.60), 0.05).when(ratio < 0.25, -0.16).otherwise(0.0)
        + F.when(longest > 3, -0.22).when(longest == 3, -0.10).otherwise(0.0)
    )
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(n == 0, 0.0).when(n == 1, F.when(v == 1, 0.45).otherwise(0.25)).when(v == 0, 0.12).otherwise(clipped)


def english_plausibility(token: Column) -> Column:
    return _plausibility(token, "aeiouyAEIOUY", "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ")


def russian_plausibility(token: Column) -> Column:
    return _plausibility(token, "аеёиоуыэюяАЕЁИОУЫЭЮЯ", "бвгджзйклмнпрстфхцчшщъьБВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ")


def looks_like_url(token: Column) -> Column:
    return token.contains("://") | F.lower(token).rlike(r"^(www\.|https?://)")


def looks_like_email(token: Column) -> Column:
    return token.rlike(r"(?s)^[^@]+@(?=.)[^.]*\.")


def looks_like_path(token: Column) -> Column:
    return token.contains("\\") | (F.length(token) - F.length(F.replace(token, F.lit("/"))) >= 2) | token.rlike(r"(?s)^.+\.[A-Za-z0-9]{2,5}$")


def looks_like_identifier(token: Column) -> Column:
    return token.rlike(r"[_-]") | token.rlike(r"(?s)\p{Ll}.*[\p{Lu}\p{Lt}]")


def is_protected(token: Column) -> Column:
    """Tokens that no correction may touch."""
    odd = script(token).isin("Empty", "Mixed", "Other") & (script_for_layout(token) != "Latin")
    shape = token.rlike(r"\p{Nd}") | looks_like_url(token) | looks_like_email(token) | looks_like_path(token) | looks_like_identifier(token)
    return F.coalesce(F.lower(token).isin(*[x.lower() for x in TECHNICAL_NAMES]) | odd | shape, F.lit(True))


def transfer_case(original: Column, corrected: Column) -> Column:
    """Upper, lower, capitalised or first-letter case of ``original``, given to ``corrected``."""
    letters = F.regexp_replace(original, r"[^\p{L}]", "")
    head = F.upper(F.substring(corrected, 1, 1))
    first_upper = letters.rlike(r"^\p{Lu}")
    return (
        F.when((letters == "") | (F.coalesce(corrected, F.lit("")) == ""), corrected)
        .when(letters.rlike(r"^\p{Lu}+$"), F.upper(corrected))
        .when(~letters.rlike(r"\p{Lu}"), F.lower(corrected))
        .when(first_upper & ~letters.rlike(r"^.\p{L}*\p{Lu}"), F.concat(head, F.lower(corrected.substr(F.lit(2), F.length(corrected)))))
        .when(first_upper, F.concat(head, corrected.substr(F.lit(2), F.length(corrected))))
        .otherwise(corrected)
    )


def fold_yo(word: Column) -> Column:
    return F.translate(word, "Ёё", "Ее")


def digest(s: Column) -> Column:
    """Upper-case hex SHA-256; null for null or empty."""
    return F.upper(F.sha2(F.nullif(s, F.lit("")), 256))


def hash_split(word: Column) -> Column:
    """train, valid or test in parts 8 : 1 : 1 by the first byte of the digest."""
    d = F.conv(F.substring(F.sha2(F.lower(word), 256), 1, 2), 16, 10).cast("int") % 10
    return F.when(d < 8, "train").when(d == 8, "valid").otherwise("test")


def layout_score(original: Column, candidate: Column, p_original: Column, p_candidate: Column) -> Column:
    """How much likelier a converted token is than what was typed, from 0 to 0.95."""
    gain = p_candidate - p_original
    n = F.length(original)
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    by_length = F.when(n <= 1, 0.0).when(n == 2, 0.45).when(n == 3, 0.70).when(n == 4, 0.85).otherwise(1.0)
    raw = 0.30 + (1 - p_original) * 0.30 + p_candidate * 0.30 + clip(gain, 0.0, 0.5) * 0.20 + F.when(gain >= 0.20, 0.08).otherwise(0.0)
    return (
        F.when((p_original >= 0.70) & (p_candidate <= p_original), 0.0)
        .when(p_candidate < 0.45, clip(p_candidate * 0.35, 0.0, 0.35))
        .when(gain <= 0.05, clip(gain, 0.0, 0.25))
        .otherwise(clip(raw * by_length, 0.0, 0.95))
    )


def unknown_name_score(typed: Column, candidate: Column, p_typed: Column, p_candidate: Column) -> Column:
    """Score, from 0.73 to 0.88, of a Latin name that no lexicon has, read from Cyrillic keys; null if it is not likely enough."""
    n, gain = F.length(candidate), p_candidate - p_typed
    clip = lambda x, hi: F.greatest(F.lit(0.0), F.least(F.lit(hi), x))
    short = n <= 4
    other_keys = (F.length(typed) == n) & ~F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: typed.substr(i, F.lit(1)) == candidate.substr(i, F.lit(1)))
    shaped = typed.rlike("^[А-яЁё]{3,20}$") & candidate.rlike("^[A-Za-z]{3,20}$") & candidate.rlike("[aeiouAEIOU]")
    pronounceable = ~candidate.rlike("[^aeiouyAEIOUY]{4}") & (short | ~candidate.rlike("[^aeiouyAEIOUY]{3}"))
    long_enough_gain = (gain >= 0.18) & ((p_typed < 0.55) | (gain >= 0.25))
    gains = F.when(short, other_keys | (gain >= 0.12)).otherwise(long_enough_gain)
    better = (short & other_keys) | ((p_candidate >= 0.80) & (gain >= 0.12)) | ((p_typed < 0.50) & (p_candidate >= 0.78)) | (gain >= 0.22)
    raw = 0.70 + clip(p_candidate - 0.60, 0.22) * 0.45 + clip(1 - p_typed, 0.45) * 0.18 + clip(gain, 0.35) * 0.22
    raw = raw + F.when(other_keys & (F.length(typed) <= 4), 0.04).otherwise(0.0) + F.when(F.length(typed).between(3, 4), 0.03).otherwise(0.0)
    ok = shaped & pronounceable & (p_candidate >= F.when(short, 0.70).otherwise(0.78)) & gains & better
    return F.when(ok, F.greatest(F.lit(0.73), F.least(F.lit(0.88), raw)))


def yo_variants(word: Column) -> Column:
    """The word with all, and with each single one, of its е as ё, and the other way; empty if it has neither or is null."""
    swap = lambda olds, news: F.filter(
        F.concat(
            F.array(F.translate(word, olds, news)),
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(word.substr(F.lit(1), i - 1), F.translate(word.substr(i, F.lit(1)), olds, news), word.substr(i + 1, F.length(word)))),
        ),
        lambda v: v != word,
    )
    return F.array_distinct(F.concat(swap("еЕ", "ёЁ"), swap("ёЁ", "еЕ")))
