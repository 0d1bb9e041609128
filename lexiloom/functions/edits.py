"""Edit tests, neighbour generators and edit classes, as array and string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
# fixed values: keyboard rows of both layouts, vowels of edits, costs of edit classes
LAYOUTS = (("qwertyuiop", "asdfghjkl", "zxcvbnm"), ("йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю"))
VOWELS = "aeiou" + "аеёиоуыэюя"
COSTS = {
    "RepeatedAccidentalCharacter": 0.35,
    "AdjacentTransposition": 0.75,
    "AdjacentKeySubstitution": 0.65,
    "VowelSubstitution": 0.80,
    "GeneralSubstitution": 1.0,
    "ExtraCharacter": 1.0,
    "MissingCharacter": 1.0,
}


def key_neighbours() -> dict[str, str]:
    """Keys left, right, above and below each key of a layout, by column number."""
    out = {}
    for rows in LAYOUTS:
        for r, row in enumerate(rows):
            for c, key in enumerate(row):
                near = {rows[y][x] for y, x in ((r, c - 1), (r, c + 1), (r - 1, c), (r + 1, c)) if 0 <= y < len(rows) and 0 <= x < len(rows[y])}
                out[key] = "".join(sorted(near))
    return out


#: Every key followed by each of its neighbours, between bars.
NEIGHBOUR_PAIRS = "|" + "".join(f"{k}{c}|" for k, v in key_neighbours().items() for c in v)


def _cut(w: Column, i: Column, drop: int, put: Column | None = None) -> Column:
    """w without ``drop`` characters after the first i, and with ``put`` in their place."""
    parts = [w.substr(F.lit(1), i), *([put] if put is not None else []), w.substr(i + 1 + drop, F.length(w))]
    return F.concat(*parts)


def _places(w: Column, less: int = 0) -> Column:
    """0, 1, ... up to the length of w less one and ``less``; empty if there are none."""
    return F.when(F.length(w) > less, F.sequence(F.lit(0), F.length(w) - 1 - less)).otherwise(F.array().cast("array<int>"))


def deletions(w: Column) -> Column:
    return F.transform(_places(w), lambda i: _cut(w, i, 1))


def transpositions(w: Column) -> Column:
    swap = lambda i: F.concat(w.substr(i + 2, F.lit(1)), w.substr(i + 1, F.lit(1)))
    return F.transform(_places(w, 1), lambda i: _cut(w, i, 2, swap(i)))


def _letters() -> Column:
    return F.array(*[F.lit(c) for c in ALPHABET])


def substitutions(w: Column) -> Column:
    return F.flatten(F.transform(_places(w), lambda i: F.transform(F.filter(_letters(), lambda c: c != w.substr(i + 1, F.lit(1))), lambda c: _cut(w, i, 1, c))))


def insertions(w: Column) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(w)), lambda i: F.transform(_letters(), lambda c: _cut(w, i, 0, c))))


def adjacent_substitutions(w: Column) -> Column:
    table = F.create_map(*[x for k, v in key_neighbours().items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    near = lambda i: F.coalesce(F.try_element_at(table, w.substr(i + 1, F.lit(1))), F.array().cast("array<string>"))
    return F.flatten(F.transform(_places(w), lambda i: F.transform(near(i), lambda c: _cut(w, i, 1, c))))


def repeat_cleanups(w: Column) -> Column:
    double = F.filter(_places(w, 1), lambda i: w.substr(i + 1, F.lit(1)) == w.substr(i + 2, F.lit(1)))
    return F.transform(double, lambda i: _cut(w, i, 1))


# fixed values: vowels of the insertion family, confused Russian vowels (each way), longest token with general substitutions
INSERTED_VOWELS = "aeiouy"
CONFUSED = (("е", "и"), ("а", "я"), ("о", "а"), ("ы", "и"), ("у", "ю"), ("е", "ё"))
SUBSTITUTED_LENGTH = 8


def repeated_insertions(w: Column) -> Column:
    """w with one of its letters doubled."""
    return F.array_distinct(F.transform(_places(w), lambda i: _cut(w, i, 0, w.substr(i + 1, F.lit(1)))))


def neighbour_insertions(w: Column) -> Column:
    """w with a key beside the one before or after it put in."""
    table = F.create_map(*[x for k, v in key_neighbours().items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    near = lambda i: F.coalesce(F.try_element_at(table, w.substr(i, F.lit(1))), F.array().cast("array<string>"))
    beside = lambda i: F.concat(F.when(i > 0, near(i)).otherwise(F.array().cast("array<string>")), near(i + 1))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.length(w)), lambda i: F.transform(beside(i), lambda c: _cut(w, i, 0, c)))))


def vowel_insertions(w: Column) -> Column:
    """w with a vowel put in between two letters that are none."""
    gaps = F.filter(_places(w, 1), lambda i: ~w.substr(i + 1, F.lit(2)).rlike(f"(?i)[{INSERTED_VOWELS}]"))
    return F.array_distinct(F.flatten(F.transform(gaps, lambda i: F.transform(F.array(*[F.lit(v) for v in INSERTED_VOWELS]), lambda v: _cut(w, i + 1, 0, v)))))


def vowel_confusions(w: Column) -> Column:
    """w with one Russian vowel taken for another that it is confused with."""
    both = [(a, b) for x in CONFUSED for a, b in (x, x[::-1])]
    table = F.create_map(*[x for a in sorted({a for a, _ in both}) for x in (F.lit(a), F.array(*[F.lit(b) for k, b in both if k == a]))])
    taken = lambda i: F.coalesce(F.try_element_at(table, w.substr(i + 1, F.lit(1))), F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(_places(w), lambda i: F.transform(taken(i), lambda c: _cut(w, i, 1, c)))))


def short_substitutions(w: Column) -> Column:
    """Every substitution of a letter in words of eight letters at most, none in longer ones."""
    return F.when(F.length(w) <= SUBSTITUTED_LENGTH, substitutions(w)).otherwise(F.array().cast("array<string>"))


def one_edit_neighbours(w: Column) -> Column:
    """All distinct strings one substitution, deletion, insertion or swap away."""
    return F.array_distinct(F.concat(substitutions(w), deletions(w), insertions(w), transpositions(w)))


def first_difference(a: Column, b: Column) -> Column:
    """1-based place of the first mismatch of equally long strings; null if there is none."""
    return F.array_min(F.filter(F.transform(_places(a), lambda i: F.when(a.substr(i + 1, F.lit(1)) != b.substr(i + 1, F.lit(1)), i + 1)), lambda x: x.isNotNull()))


def shared_prefix(a: Column, b: Column) -> Column:
    """Letters that a and b begin with alike: the longest start of a that b has, too, by one match over both (texts without U+0000)."""
    return F.length(F.regexp_extract(F.concat(a, F.lit("\0"), b), r"(?s)^(.*).*\x00\1", 1))


def _from(w: Column, i: Column) -> Column:
    """w from its character i (from 1) on."""
    return w.substr(i, F.length(w))


def is_transposition(a: Column, b: Column) -> Column:
    p = shared_prefix(a, b)
    crossed = (a.substr(p + 1, F.lit(1)) == b.substr(p + 2, F.lit(1))) & (a.substr(p + 2, F.lit(1)) == b.substr(p + 1, F.lit(1)))
    return (F.length(a) == F.length(b)) & (a != b) & crossed & (_from(a, p + 3) == _from(b, p + 3))


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(_places(a), lambda i: a.substr(i + 1, F.lit(1)) != b.substr(i + 1, F.lit(1))))


def classify_edit(observed: Column, source: Column) -> Column:
    """The kind of slip that turns ``source`` into ``observed``; the first that fits, Unknown if none does."""
    n, m = F.length(observed), F.length(source)
    # all follows from the first place where they differ: an extra letter stands there, or ends a run of its kind
    p = shared_prefix(observed, source)
    i = p + 1
    was, now = source.substr(i, F.lit(1)), observed.substr(i, F.lit(1))
    extra, missing = _from(observed, p + 2) == _from(source, i), _from(observed, i) == _from(source, p + 2)
    repeated = extra & (p >= 1) & (observed.substr(p, F.lit(1)) == now)
    near = F.lit(NEIGHBOUR_PAIRS).contains(F.concat(F.lit("|"), was, now, F.lit("|")))
    vowels = was.isin(*VOWELS) & now.isin(*VOWELS)
    one = (n == m) & (observed != source) & (_from(observed, p + 2) == _from(source, p + 2))
    return (
        F.when((n == m + 1) & repeated, "RepeatedAccidentalCharacter")
        .when(is_transposition(observed, source), "AdjacentTransposition")
        .when(one & near, "AdjacentKeySubstitution")
        .when(one & vowels, "VowelSubstitution")
        .when(one, "GeneralSubstitution")
        .when((n == m + 1) & extra, "ExtraCharacter")
        .when((n == m - 1) & missing, "MissingCharacter")
        .otherwise("Unknown")
    )


def edit_cost(kind: Column) -> Column:
    out = F.lit(2.0)
    for k, v in COSTS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out
