"""Early layout: whether the first letters of a word were typed on the wrong layout, from prefixes and letter triples of both languages.

Words of both languages are compared by the physical keys that type them, written as the English letters of these keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T

# fixed values: the letter keys of both layouts, in the same order
EN_ROW, RU_ROW = "qwertyuiop[]asdfghjkl;'zxcvbnm,.`", "йцукенгшщзхъфывапролджэячсмитьбюё"
START = "^"
#: Longest prefix that is looked up, longest word that is learnt.
LONGEST, LONGEST_WORD = 10, 128
# fixed values: prior masses; what three letters need beyond the margin, and in words that go on from them
ALPHA, BETA = 0.1, 2.0
SHORT_MARGIN, SHORT_WORDS = 1.5, 8
LANGUAGES = ("en", "ru")


@dataclass
class EarlyModel:
    """prefixes(keys, en, ru): distinct words that begin so; triples(gram, en, ru): log probability of the last key after the two before it,
    one row for each of the 34 * 34 * 33 triples, so it may always be broadcast."""

    prefixes: DataFrame
    triples: DataFrame


def physical_keys(word: Column, lang: Column) -> Column:
    """The keys that type a word of ``lang`` (en or ru); null if it has other characters, is empty or null, or of another language."""
    low = F.lower(word)
    return F.when((lang == "en") & low.rlike(r"^[a-z\[\];',.`]+$"), low).when((lang == "ru") & low.rlike("^[а-яё]+$"), F.translate(low, RU_ROW, EN_ROW))


def other_layout(word: Column, lang: Column) -> Column:
    return F.when(lang == "en", T.to_russian_layout(word)).otherwise(T.to_english_layout(word))


def _prefixes(keys: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.least(F.length(keys), F.lit(LONGEST))), lambda k: F.col(keys).substr(F.lit(1), k))


def _grams(keys: str) -> Column:
    padded = F.concat(F.lit(START * 2), F.col(keys))
    return F.transform(F.sequence(F.lit(1), F.length(keys)), lambda i: padded.substr(i, F.lit(3)))


def train(words: DataFrame) -> EarlyModel:
    """The model of ``words(lang, word, weight)``. Of rows that differ in case only, the largest weight counts; weights that are not positive
    and finite, other languages, and words with other characters or over 128 go. A language without words knows no prefix."""
    usable = (F.col("weight") > 0) & (F.col("weight") < float("inf")) & F.col("word").isNotNull() & (F.length("word") <= LONGEST_WORD)
    keyed = words.filter(usable).select("weight", "lang", physical_keys(F.col("word"), F.col("lang")).alias("keys")).filter("keys is not null")
    keyed = keyed.groupBy("lang", "keys").agg(F.max("weight").alias("weight"))
    prefixes = keyed.select("lang", F.explode(_prefixes("keys")).alias("keys")).groupBy("keys").agg(*[F.count_if(F.col("lang") == x).alias(x) for x in LANGUAGES])
    seen = keyed.select("lang", "weight", F.explode(_grams("keys")).alias("gram")).groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == x, F.col("weight"))).alias(x) for x in LANGUAGES])
    signs = EN_ROW + START
    n, letters = len(signs), len(EN_ROW)
    sign = lambda i: F.lit(signs).substr(i.cast("int") + 1, F.lit(1))
    i = F.col("id")
    grid = words.sparkSession.range(n * n * letters).select(sign(F.floor(i / (n * letters))).alias("a"), sign(F.floor(i / letters) % n).alias("b"), sign(i % letters).alias("c"))
    full = grid.withColumn("gram", F.concat("a", "b", "c")).join(seen, "gram", "left").fillna(0.0, list(LANGUAGES))
    mass = lambda x, *by: F.sum(x).over(Window.partitionBy(*by))
    logs = []
    for x in LANGUAGES:
        one = (mass(x, "c") + ALPHA) / (mass(x) + n * ALPHA)
        two = (mass(x, "b", "c") + BETA * one) / (mass(x, "b") + BETA)
        logs.append(F.log((F.col(x) + BETA * two) / (mass(x, "a", "b") + BETA)).alias(x))
    return EarlyModel(prefixes, full.select("gram", *logs))


def evidence(tokens: DataFrame, model: EarlyModel, shortest: int = 4, continuations: int = 1) -> DataFrame:
    """token, lang, state, margin of the distinct ``tokens(token, lang)``, lang being the layout in use.

    state is Invalid (no keys of that layout, or another language), Protected (no correction may touch it, or all capitals), Wait (too short or
    long, a prefix of its own language, or of fewer than ``continuations`` words of the other) or Open. margin is the mean log
    probability of its keys in the other language less that in its own, where Open, and null elsewhere. A null token is Protected.
    """
    token, n = F.col("token"), F.length("token")
    capitals = (n > 1) & token.rlike(r"^\p{Lu}+$")
    keys = physical_keys(token, F.col("lang"))
    first = (
        F.when(~F.coalesce(F.col("lang").isin(*LANGUAGES), F.lit(False)), "Invalid")
        .when(T.is_protected(token) | F.coalesce(capitals, F.lit(True)), "Protected")
        .when((n < shortest) | (n > LONGEST), "Wait")
        .when(keys.isNull(), "Invalid")
    )
    rows = tokens.select("token", "lang").distinct().withColumn("first", first).withColumn("keys", F.when(first.isNull(), keys))
    rows = rows.join(model.prefixes.select("keys", *[F.col(x).alias(f"n_{x}") for x in LANGUAGES]), "keys", "left").fillna(0, ["n_en", "n_ru"])
    english = F.col("lang") == "en"
    own, other = F.when(english, F.col("n_en")).otherwise(F.col("n_ru")), F.when(english, F.col("n_ru")).otherwise(F.col("n_en"))
    open_ = (own == 0) & (other >= continuations) & ((n != 3) | (other >= SHORT_WORDS))
    state = F.coalesce("first", F.when(open_, "Open").otherwise("Wait"))
    # keys that are open in both layouts differ in sign only, so triples are looked up once for each sequence of keys
    rows = rows.select("token", "lang", state.alias("state"), F.when(state == "Open", F.col("keys")).alias("keys"))
    spelt = rows.filter("keys is not null").select("keys").distinct().select("keys", F.explode(_grams("keys")).alias("gram"))
    gain = spelt.join(F.broadcast(model.triples), "gram").groupBy("keys").agg(F.avg(F.col("ru") - F.col("en")).alias("gain"))
    margin = F.when(english, F.col("gain")).otherwise(-F.col("gain"))
    return rows.join(gain, "keys", "left").select("token", "lang", "state", margin.alias("margin"))


def needed(token: Column, margin: float) -> Column:
    """The margin that a token of this length needs."""
    return F.lit(float(margin)) + F.when(F.length(token) == 3, SHORT_MARGIN).otherwise(0.0)


def verdicts(tokens: DataFrame, model: EarlyModel, margin: float = 1.25, shortest: int = 4, continuations: int = 1) -> DataFrame:
    """token, lang, verdict, margin: Candidate where Open with the needed margin, else Wait, Protected or Invalid."""
    found = evidence(tokens, model, shortest, continuations)
    verdict = F.when(F.col("state") != "Open", F.col("state")).when(F.col("margin") >= needed(F.col("token"), margin), "Candidate").otherwise("Wait")
    return found.select("token", "lang", verdict.alias("verdict"), "margin")


def _asked(words: DataFrame, shortest: int) -> DataFrame:
    """word, lang, k, token of the prefixes of ``words(lang, word)`` from ``shortest`` letters on."""
    sizes = F.sequence(F.lit(shortest), F.least(F.length("word"), F.lit(LONGEST)))
    rows = words.filter(F.length("word") >= shortest).select("lang", "word").distinct().select("lang", "word", F.explode(sizes).alias("k"))
    return rows.withColumn("token", F.col("word").substr(F.lit(1), F.col("k")))


def session_switches(words: DataFrame, model: EarlyModel, margin: float = 1.25, shortest: int = 4, continuations: int = 1) -> DataFrame:
    """lang, word, length, switched: for distinct typed words, the first prefix at which a session switches the layout, and the prefix on the
    other layout. A word switches once at most; words that never switch are left out."""
    asked = _asked(words, shortest)
    found = verdicts(asked, model, margin, shortest, continuations).filter("verdict = 'Candidate'").select("token", "lang")
    first = asked.join(found, ["token", "lang"]).groupBy("lang", "word").agg(F.min("k").alias("length"))
    return first.withColumn("switched", other_layout(F.col("word").substr(F.lit(1), F.col("length")), F.col("lang")))


def switch_audit(words: DataFrame, model: EarlyModel, margins: list[float], shortest: int = 4, continuations: int = 1) -> DataFrame:
    """margin, lang, eligible, positions, false_switches, recovered, missed, before_end over distinct ``words(lang, word)``.

    false_switches are words that switch although typed on their own layout; recovered those that switch when typed on the other,
    before_end of them before the last letter. All margins are read from one scoring of each prefix.
    """
    right = _asked(words, shortest)
    flipped = F.when(F.col("lang") == "en", "ru").otherwise("en")
    wrong = right.select("lang", "word", "k", other_layout(F.col("token"), F.col("lang")).alias("token"), flipped.alias("typed"), F.lit(True).alias("wrong"))
    asked = right.select("lang", "word", "k", "token", F.col("lang").alias("typed"), F.lit(False).alias("wrong")).unionByName(wrong)
    found = evidence(asked.select("token", F.col("typed").alias("lang")), model, shortest, continuations).filter("state = 'Open'")
    found = found.select("token", F.col("lang").alias("typed"), (F.col("margin") - needed(F.col("token"), 0.0)).alias("margin"))
    rows = asked.join(found, ["token", "typed"], "left")
    first = [F.min(F.when(F.col("wrong") & (F.col("margin") >= m), F.col("k"))).alias(f"k{i}") for i, m in enumerate(margins)]
    each = rows.groupBy("lang", "word").agg(F.max(F.when(~F.col("wrong"), F.col("margin"))).alias("own"), F.count_if(~F.col("wrong")).alias("positions"), *first)
    at = F.array(*[F.struct(F.lit(float(m)).alias("margin"), F.col(f"k{i}").alias("k")) for i, m in enumerate(margins)])
    each = each.select("lang", "word", "own", "positions", F.explode(at).alias("m")).select("lang", "word", "own", "positions", "m.margin", "m.k")
    out = each.groupBy("margin", "lang").agg(
        F.count(F.lit(1)).alias("eligible"), F.sum("positions").alias("positions"), F.count_if(F.col("own") >= F.col("margin")).alias("false_switches"),
        F.count("k").alias("recovered"), F.count_if(F.col("k").isNull()).alias("missed"), F.count_if(F.col("k") < F.length("word")).alias("before_end"),
    )
    return out


def safe_margin(audit: DataFrame) -> DataFrame:
    """margin, safe: the least margin of a switch_audit without false switches, or the greatest where each has some."""
    by = audit.groupBy("margin").agg(F.sum("false_switches").alias("f"))
    least = F.min(F.when(F.col("f") == 0, F.col("margin")))
    return by.agg(F.coalesce(least, F.max("margin")).alias("margin"), least.isNotNull().alias("safe"))
