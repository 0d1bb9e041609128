"""Russian orthography: bounded rewriting of words by tables of small changes, and the choice of one dictionary word.

A family of changes maps a word to the array of words that one change gives. Families are followed one or two steps deep. All variants of all
tokens meet the dictionary in one join on equal strings; each family then has a rule that picks a word or none, and the first
family in order that picks one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import edits as E
from lexiloom.functions import text as T
from lexiloom.operators import candidates as C
from lexiloom.sources.shared import spread, stored

# fixed values: letters, consonants that are often doubled, consonants and vowels, spellings that are never right, vowels taken for one another, endings
ALPHABET = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
OFTEN_DOUBLED = "лнстпмфкр"
CONSONANTS = "бвгджзклмнпрстфхцчшщ"
VOWELS = "аеёиоуыэюя"
DIGRAPHS = (("жы", "жи"), ("шы", "ши"), ("чя", "ча"), ("щя", "ща"), ("чю", "чу"), ("щю", "щу"), ("здел", "сдел"))
FORBIDDEN = ("жы", "шы", "чя", "щя", "чю", "щю")
VOWEL_PAIRS = (("а", "о"), ("о", "а"), ("е", "и"), ("и", "е"), ("ы", "и"), ("и", "ы"), ("я", "а"), ("а", "я"), ("ё", "е"), ("е", "ё"))
DOUBLE_ENDING = ("тть", "тать")

_NONE = "array<string>"


def _at(w: Column, i: Column, n: int = 1) -> Column:
    return w.substr(i + 1, F.lit(n))


def _join(w: Column, i: Column, drop: int, put: Column) -> Column:
    return F.concat(w.substr(F.lit(1), i), put, w.substr(i + 1 + drop, F.length(w)))


def _starts(w: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.length(w) - 1, F.lit(0)))


def digraphs(w: Column) -> Column:
    """A spelling that is never right, put right at one place."""
    one = lambda old, new: F.transform(F.filter(_starts(w), lambda i: _at(w, i, len(old)) == old), lambda i: _join(w, i, len(old), F.lit(new)))
    return F.concat(*[one(a, b) for a, b in DIGRAPHS])


def doubled_consonants(w: Column) -> Column:
    """One consonant of the list doubled where it stands alone."""
    alone = lambda i: _at(w, i).isin(*OFTEN_DOUBLED) & (F.when(i > 0, _at(w, i - 1)).otherwise("") != _at(w, i)) & (_at(w, i + 1) != _at(w, i))
    return F.transform(F.filter(_starts(w), alone), lambda i: _join(w, i, 0, _at(w, i)))


def soft_signs(w: Column) -> Column:
    """A soft sign added to or taken from the end, or put between л and н."""
    some = lambda test, value: F.when(test, F.array(value)).otherwise(F.array().cast(_NONE))
    inside = F.transform(F.filter(_starts(w), lambda i: _at(w, i, 2) == "лн"), lambda i: _join(w, i + 1, 0, F.lit("ь")))
    return F.concat(some(F.length(w) >= 3, F.concat(w, F.lit("ь"))), some(w.endswith("ь"), w.substr(F.lit(1), F.length(w) - 1)), inside)


def endings(w: Column) -> Column:
    """A letter that is missing from an ending."""
    n = F.length(w)
    before_last = lambda c: F.concat(w.substr(F.lit(1), n - 1), F.lit(c), F.right(w, F.lit(1)))
    made = [
        F.when((n >= 5) & w.endswith("не"), before_last("и")),
        F.when((n >= 5) & w.endswith("ни"), F.concat(w, F.lit("е"))),
        F.when((n >= 4) & w.endswith("фес"), before_last("й")),
        F.when(w.endswith(DOUBLE_ENDING[0]), F.concat(w.substr(F.lit(1), n - 3), F.lit(DOUBLE_ENDING[1]))),
    ]
    inside = F.transform(F.filter(_starts(w), lambda i: _at(w, i + 1, 3) == "ние"), lambda i: _join(w, i + 1, 0, F.lit("е")))
    return F.concat(F.array_compact(F.array(*made)), inside)


def vowel_changes(w: Column) -> Column:
    """One vowel taken for another that it is taken for."""
    one = lambda old, new: F.transform(F.filter(_starts(w), lambda i: _at(w, i) == old), lambda i: _join(w, i, 1, F.lit(new)))
    return F.concat(*[one(a, b) for a, b in VOWEL_PAIRS])


def insertions(w: Column) -> Column:
    letters = F.array(*map(F.lit, ALPHABET))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(w)), lambda i: F.transform(letters, lambda c: _join(w, i, 0, c))))


def swaps(w: Column) -> Column:
    """Two different neighbours swapped."""
    return F.filter(E.transpositions(w), lambda v: v != w)


def structural_changes(w: Column) -> Column:
    return F.concat(digraphs(w), doubled_consonants(w), soft_signs(w), E.repeat_cleanups(w))


def followed(step, w: Column, depth: int) -> Column:
    """Distinct words up to ``depth`` steps from w, without w itself."""
    reached = F.array_distinct(step(w))
    found = reached
    for _ in range(depth - 1):
        reached = F.array_distinct(F.flatten(F.transform(reached, step)))
        found = F.concat(found, reached)
    return F.filter(F.array_distinct(found), lambda v: v != w)


def lengthened_cleanups(w: Column) -> Column:
    """A doubled letter reduced, and the same with any doubled letter of the word at its end."""
    double = F.transform(F.filter(_starts(w), lambda i: (_at(w, i) == _at(w, i + 1)) & (_at(w, i + 1) != "")), lambda i: _at(w, i))
    cut = E.repeat_cleanups(w)
    return F.array_distinct(F.concat(cut, F.flatten(F.transform(cut, lambda v: F.transform(double, lambda c: F.concat(v, c))))))


#: Families in the order in which they decide.
FAMILIES = {
    "digraph": lambda w: F.array_distinct(digraphs(w)),
    "ending": lambda w: F.array_distinct(endings(w)),
    "vowel": lambda w: F.when(F.length(w) >= 4, followed(vowel_changes, w, 2)).otherwise(F.array().cast(_NONE)),
    "repeated": lengthened_cleanups,
    "insertion": lambda w: F.array_distinct(insertions(w)),
    "swap": lambda w: F.when(F.length(w) > 3, F.array_distinct(swaps(w))).otherwise(F.array().cast(_NONE)),
    "double_soft": lambda w: F.array_distinct(F.flatten(F.transform(doubled_consonants(w), soft_signs))),
    "structure": lambda w: followed(structural_changes, w, 2),
    "shape": lambda w: F.array_distinct(F.concat(insertions(w), swaps(w), E.repeat_cleanups(w))),
}


#: The families without insertions.
SHORT_FAMILIES = {f: x for f, x in FAMILIES.items() if f not in ("insertion", "shape")} | {"shape": lambda w: F.array_distinct(F.concat(swaps(w), E.repeat_cleanups(w)))}


def variants(tokens: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """token, family, variant: every distinct variant of each token, lower-cased, by family."""
    w = F.lower("token")
    rows = tokens.select("token", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), FAMILIES[f](w).alias("made")) for f in families])).alias("f"))
    return rows.select("token", "f.family", F.explode("f.made").alias("variant"))


def inserted(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, variant, freq: the words of ``words(word, freq)`` among the ``insertions`` of each token: those that leave the token when one of
    their letters of the alphabet goes. The words' deletions meet the tokens, so that no insertion is written out."""
    w = F.col("word")
    cut = F.transform(F.filter(_starts(w), lambda i: F.lit(ALPHABET).contains(_at(w, i)) & (_at(w, i) != "")), lambda i: _join(w, i, 1, F.lit("")))
    keys = words.select(w.alias("variant"), "freq", F.explode(F.array_distinct(cut)).alias("low"))
    return tokens.select("token", F.lower("token").alias("low")).join(keys, "low").select("token", "variant", "freq")


def _doubles(token: Column, v: Column) -> Column:
    """Whether v has a doubled consonant that the token lacks, alone or beside one soft sign more."""
    cut = F.transform(F.filter(_starts(v), lambda i: (_at(v, i) == _at(v, i + 1)) & _at(v, i).isin(*CONSONANTS)), lambda i: _join(v, i, 1, F.lit("")))
    softened = lambda r: F.exists(F.filter(_starts(r), lambda i: _at(r, i) == "ь"), lambda i: _join(r, i, 1, F.lit("")) == token)
    return F.exists(cut, lambda r: (r == token) | softened(r))


def _softens(token: Column, v: Column) -> Column:
    return token.contains("лн") & v.contains("льн")


def _signals(token: Column, v: Column) -> Column:
    return _doubles(token, v).cast("int") + (token.endswith("ь") != v.endswith("ь")).cast("int") + _softens(token, v).cast("int")


def _changes(token: Column, v: Column) -> Column:
    return F.when(F.length(token) == F.length(v), E.hamming(token, v))


def _word(s: Column) -> Column:
    return F.get(s, F.lit(0))["word"]


def _freq(s: Column, i: int) -> Column:
    return F.coalesce(F.get(s, F.lit(i))["freq"], F.lit(0.0))


def _only(s: Column) -> Column:
    return F.when(F.size(s) == 1, _word(s))


def _leading(s: Column, least: float, lead: float, alone: bool = True) -> Column:
    """The most frequent word, if it is the only one (``alone``), or frequent and ahead of the next."""
    ahead = (_freq(s, 0) >= least) & (F.round(_freq(s, 0) - _freq(s, 1), 9) >= lead)
    single = (F.size(s) == 1) & (F.lit(True) if alone else _freq(s, 0) >= least)
    return F.when(single | ((F.size(s) > 1) & ahead), _word(s))


def _structural(s: Column) -> Column:
    """The one word with the most signs of a structural slip."""
    most = F.array_max(F.transform(s, lambda x: x["signals"]))
    return _only(F.filter(s, lambda x: x["signals"] == most))


def _vowel_choice(s: Column) -> Column:
    """Over words with their number of changes: a very frequent one-change word, an only two-change word, or a clear best."""
    least = F.array_min(F.transform(s, lambda x: x["changes"]))
    nearest = F.filter(s, lambda x: x["changes"] == least)
    one = (least == 1) & (_freq(nearest, 0) >= 0.96) & ((F.size(nearest) == 1) | (F.round(_freq(nearest, 0) - _freq(nearest, 1), 9) >= 0.05))
    better = F.exists(s, lambda x: (x["changes"] > least) & (x["freq"] >= 0.95))
    two = (least >= 2) & (F.size(nearest) == 1) & (_freq(nearest, 0) >= 0.85) & ~better
    ranked = F.array_sort(s, lambda a, b: F.when(a["freq"] != b["freq"], F.signum(b["freq"] - a["freq"]).cast("int")).otherwise(a["changes"] - b["changes"]))
    rest = F.array_max(F.transform(F.filter(F.slice(ranked, 2, 10_000), lambda x: x["freq"] > 0.75), lambda x: x["freq"]))
    best = F.get(ranked, F.lit(0))
    clear = (best["changes"] >= 2) & (best["freq"] >= 0.95) & F.coalesce(F.round(best["freq"] - rest, 9) >= 0.15, F.lit(True))
    return F.when(one, _word(nearest)).when(two, _word(nearest)).when(clear, best["word"])


def corrections(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token, word, family of the distinct ``tokens(token)`` for which a family picks a word of ``dictionary(word, freq)``.

    Known words, null tokens and those of fewer than three letters have none. A token with a spelling that is never right is left to the first family.
    """
    words = C.sized(stored(dictionary.select(T.lookup_key(F.col("word")).alias("word"), "freq").groupBy("word").agg(F.max("freq").alias("freq")), "words"))
    rows = tokens.filter(F.length("token") >= 3).select("token", F.lower("token").alias("low")).distinct()
    open_ = rows.join(words.select(F.col("word").alias("low")), "low", "left_anti")
    open_ = stored(open_.select("token"), "open")
    # insertions, a family and part of another, come from the words' side; the rest is written out and looked up
    made = [F.struct(F.lit(f).alias("family"), x.alias("made")) for f, x in ((f, SHORT_FAMILIES[f](F.lower("token"))) for f in SHORT_FAMILIES)]
    rest = spread(open_, "token").select("token", F.explode(F.array(*made)).alias("f")).select("token", "f.family", F.explode("f.made").alias("variant"))
    rest = rest.join(words.withColumnRenamed("word", "variant"), "variant").select("token", "family", "variant", "freq")
    longer = inserted(open_, words).select("token", F.explode(F.array(F.lit("insertion"), F.lit("shape"))).alias("family"), "variant", "freq")
    # a swap or a cleanup has not the length of an insertion, so that no variant comes both ways
    met = rest.unionByName(longer).withColumn("low", F.lower("token"))
    low, v = F.col("low"), F.col("variant")
    facts = F.struct((-F.col("freq")).alias("order"), v.alias("word"), "freq", F.when(F.col("family") == "vowel", _changes(low, v)).alias("changes"), F.when(F.col("family") == "structure", _signals(low, v)).alias("signals"),
        F.when(F.col("family") == "structure", _doubles(low, v) & _softens(low, v)).alias("both"))
    grouped = met.groupBy("token", "family").agg(F.array_sort(F.collect_list(facts)).alias("s"))
    s, f = F.col("s"), F.col("family")
    longer = F.filter(s, lambda x: F.length(x["word"]) == F.length("token") + 1)
    both = F.filter(s, lambda x: x["both"])
    structure = F.coalesce(_only(both), _structural(s))
    shape = F.coalesce(_leading(longer, 0.85, 0.12), _leading(s, 0.85, 0.15))
    picked = (
        F.when(f.isin("digraph", "ending", "swap", "double_soft"), _only(s)).when(f == "vowel", _vowel_choice(s)).when(f == "repeated", _leading(s, 0.85, 0.01))
        .when(f == "insertion", _leading(longer, 0.90, 0.10, alone=False)).when(f == "structure", structure).otherwise(shape)
    )
    stopped = F.lower("token").rlike("|".join(FORBIDDEN)) & (f != "digraph")
    place = F.array_position(F.array(*map(F.lit, FAMILIES)), f)
    found = grouped.select("token", "family", picked.alias("word"), place.alias("place")).filter(F.col("word").isNotNull() & ~stopped)
    first = found.groupBy("token").agg(F.min(F.struct("place", "family", "word")).alias("b"))
    return first.select("token", "b.word", "b.family")

