"""Decision tables for layout, spelling and combined corrections.

A table is a list of rules in order: a name, a verdict, and a condition over the facts of a row. ``first_match`` compiles it into one expression
that gives the verdict and the name of the first rule that fits, so that a query can say why a token was, or was not, changed.
Facts are joined from the dictionary and from the token's one-edit sources: ``layout_facts`` and ``spelling_facts``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import candidates as C
from lexiloom.operators import gates as G
from lexiloom.operators import lookups as K
from lexiloom.sources.shared import stored

ALLOW, WAIT, KEEP = "allow", "wait", "no_change"
# fixed values: frequencies that targets need, by rule
FREQUENT, FORCED, TECHNICAL, ANCHORED, ULTRA, SOFT_SIGN, SAFE = 0.70, 0.80, 0.80, 0.49, 0.9992, 0.70, 0.65
# fixed values: plausibilities of technical, of strong and of typed words, a lead of a very frequent word, the longest image of an unknown word
P_TECHNICAL, P_STRONG, P_RUSSIAN, P_ENGLISH, ULTRA_GAIN, LONGEST_IMAGE, NEAR_FREQ = 0.78, 0.82, 0.90, 0.85, 0.04, 8, 0.12
# fixed values: short English words that need no sentence around them, names that only keys of the other layout spell
AUTONOMOUS = (
    "he", "her", "hers", "him", "his", "i", "it", "its", "me", "my", "our", "ours", "she", "them", "they", "this", "that", "the", "us", "we", "who", "whom", "you", "your",
)
NAME_ANCHORS = ("мущ", "пзг")


#: Entries up to which a dictionary is sent to all executors.
BROADCAST_ENTRIES = 50_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    when: Column


def first_match(rules: list[Rule], verdict: str = KEEP) -> Column:
    """(verdict, rule) of the first rule whose condition is true; null conditions are not. ``verdict`` if none is."""
    made = lambda v, n: F.struct(F.lit(v).alias("verdict"), F.lit(n).cast("string").alias("rule"))
    out = made(verdict, None)
    for r in reversed(rules):
        out = F.when(r.when, made(r.verdict, r.name)).otherwise(out)
    return out


def _other(lang: Column) -> Column:
    return F.when(lang == "en", "ru").when(lang == "ru", "en")


def layout_image(token: Column, lang: Column) -> Column:
    """What the keys of a token of ``lang`` give on the other layout."""
    return F.when(lang == "en", T.to_russian_layout(token)).when(lang == "ru", T.to_english_layout(token))


def _dictionary(dictionary: DataFrame) -> DataFrame:
    """One row a key and language, stored; Russian keys with е for ё. A table made here is taken as it is. Six facts a row come from it, so that
    only a small one is sent to all executors."""
    if "key" in dictionary.columns:
        return C.sized(dictionary, BROADCAST_ENTRIES)
    key = F.when(F.col("lang") == "ru", T.fold_yo(T.lookup_key(F.col("word")))).otherwise(T.lookup_key(F.col("word")))
    flag = lambda c: F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c)
    one = dictionary.select(key.alias("key"), "lang", "freq", "never", "user").groupBy("key", "lang").agg(F.max(F.coalesce("freq", F.lit(K.USER_FREQ))).alias("freq"), flag("never"), flag("user"))
    return stored(one, "dictionary")


def _analysed(proposals: DataFrame, table: DataFrame) -> DataFrame:
    """The mutation analysis of the proposals' tokens, stored."""
    return stored(mutation_analysis(proposals.filter("token is not null and lang is not null").select("token", "lang"), table), "analysis")


def _with_entry(rows: DataFrame, table: DataFrame, word: Column, lang: Column, name: str) -> DataFrame:
    """``name``_known, _freq, _never and _user of the word in the dictionary."""
    key = F.when(lang == "ru", T.fold_yo(T.lookup_key(word))).otherwise(T.lookup_key(word))
    entry = table.select(F.col("key").alias("_key"), F.col("lang").alias("_lang"), *[F.col(c).alias(f"{name}_{c}") for c in ("freq", "never", "user")])
    found = rows.join(entry, (key == F.col("_key")) & (lang == F.col("_lang")), "left").drop("_key", "_lang")
    flags = {f"{name}_{c}": F.coalesce(f"{name}_{c}", F.lit(False)) for c in ("never", "user")}
    return found.withColumn(f"{name}_known", F.col(f"{name}_freq").isNotNull()).withColumns(flags).withColumn(f"{name}_freq", F.coalesce(f"{name}_freq", F.lit(0.0)))


def mutation_analysis(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token, lang, class, target, n_sources, rival, safe of the distinct ``tokens(token, lang)``, lower-cased.

    class is Invalid (not letters only), Protected, OtherScript (not the letters of lang), KnownWord (in the dictionary, or never to be
    corrected), Unique or Ambiguous, in that order; the last two come from the token's one-edit sources, and a token without any is Ambiguous.
    rival says that a rule of peers finds a rival of the unique target, safe that the target passes the threshold of its operation.
    """
    t, table = F.col("token"), _dictionary(dictionary)
    rows = tokens.select(F.lower("token").alias("token"), "lang").distinct()
    rows = _with_entry(rows, table, t, F.col("lang"), "own")
    own_script = F.when(F.col("lang") == "en", T.script(t) == "Latin").when(F.col("lang") == "ru", T.script(t) == "Cyrillic")
    letters = F.coalesce(t.rlike(r"^\p{L}+$"), F.lit(False))
    before = F.when(~letters, "Invalid").when(T.is_protected(t), "Protected").when(~F.coalesce(own_script, F.lit(False)), "OtherScript").when(F.col("own_known"), "KnownWord")
    rows = rows.select("token", "lang", before.alias("before"))
    # the scripts of the languages share no letter, so that one join of neighbours serves both
    lexicon = table.filter("not never").select(F.col("key").alias("word"), "freq")
    open_ = rows.filter("before is null").select("token").distinct()
    sources = C.mutation_sources(C.one_edit_pairs(open_, lexicon, ("freq",)), lexicon)
    found = C.classify_mutations(sources, keep=True).withColumn("own", F.get(F.filter("sources", lambda s: s["word"] == F.col("target")), F.lit(0)))
    found = found.select("token", "class", "target", "n_sources", G.has_rival(F.col("own"), F.col("sources")).alias("rival"), G.passes_precision(F.col("own")).alias("safe"))
    rows = rows.join(found, "token", "left")
    kind = F.coalesce("before", "class", F.lit("Ambiguous"))
    return rows.select("token", "lang", kind.alias("class"), "target", F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"), F.coalesce("rival", F.lit(False)).alias("rival"), F.coalesce("safe", F.lit(False)).alias("safe"))


def layout_facts(proposals: DataFrame, dictionary: DataFrame, analysis: DataFrame) -> DataFrame:
    """The facts that layout rules speak of, for ``proposals(token, replacement, lang, strong_ru, strong_en, some_en)``: lang is the language of
    the token as it stands, the last three say how sure the sentence's language is (Russian, English, English and nothing else yet)."""
    t, r, lang = F.col("token"), F.col("replacement"), F.col("lang")
    table = _dictionary(dictionary)
    rows = proposals.withColumns({"low": F.lower("token"), "goal": F.lower("replacement"), "other": _other(lang)})
    rows = _with_entry(rows, table, t, lang, "own")
    rows = _with_entry(rows, table, r, F.col("other"), "new")
    rows = _with_entry(rows, table, t, F.col("other"), "cross")
    seen = analysis.select(F.col("token").alias("low"), "lang", "class", "target", "n_sources", "rival")
    rows = rows.join(seen, ["low", "lang"], "left")
    service = K.service_word(t)
    typed = F.when(lang == "en", T.english_plausibility(t)).otherwise(T.russian_plausibility(t))
    goal = F.when(lang == "en", T.russian_plausibility(r)).otherwise(T.english_plausibility(r))
    return rows.withColumns({"image": F.lower(layout_image(t, lang)), "anchor": K.is_layout_anchor(t), "alias": K.anchor_alias(t), "service": service["word"], "service_lang": service["target"], "p_typed": typed, "p_goal": goal, "layout_script": T.script_for_layout(t)})


def _nothing_to_do() -> Rule:
    t, r = F.col("token"), F.col("replacement")
    return Rule("nothing_to_do", KEEP, F.coalesce((F.trim(t) == "") | (F.trim(r) == "") | (F.lower(t) == F.lower(r)), F.lit(True)))


def layout_rules() -> list[Rule]:
    """Rules for a replacement that is the token's image on the other layout."""
    c = F.col
    lang, low, goal, freq = c("lang"), c("low"), c("goal"), c("new_freq")
    english, russian = lang == "en", lang == "ru"
    short = F.length(low).between(1, 4)
    ambiguous, unique = c("class") == "Ambiguous", c("class") == "Unique"
    anchor, gain = c("anchor"), F.round(c("p_goal") - c("p_typed"), 9)
    good = c("new_known") & ~c("new_never")
    ultra = F.length(goal).between(1, 4) & c("new_known") & (freq >= ULTRA)
    in_context = F.when(english, c("strong_ru")).otherwise(c("strong_en") | c("some_en"))
    sure_context = F.when(english, c("strong_ru")).otherwise(c("strong_en"))
    known_in_context = short & c("own_known") & ~c("own_never") & ~c("own_user") & ultra & in_context
    exact = (F.length(low) == F.length(goal)) & ~c("own_never") & ~c("own_user") & ~c("own_known") & good & K.allows_short_layout(low, freq, F.lit(0.0), gain, sure_context)
    autonomous = russian & goal.isin(*AUTONOMOUS) & ultra & (gain >= ULTRA_GAIN)
    known = c("own_known") | c("own_never")
    fixed = known & ~(english & (c("service_lang") == "ru") & c("service").isNotNull())
    tech_shape = russian & goal.rlike("^[a-z]{3,4}$") & goal.rlike("[aeiou]")
    named = T.unknown_name_score(low, goal, c("p_typed"), c("p_goal")).isNotNull() & ~c("new_never")
    named_anchor = low.isin(*NAME_ANCHORS)
    no_rivals = anchor | ~(ambiguous | unique)
    script = lambda x: T.script(x)
    clash = (script(c("target")) == script(goal)) | ((script(c("target")) == c("layout_script")) & (russian | ~anchor))
    return [
        _nothing_to_do(),
        Rule("no_language", KEEP, lang.isNull()),
        Rule("service_word", ALLOW, (c("service_lang") == c("other")) & (F.lower("service") == goal)),
        Rule("other_service_word", WAIT, c("service").isNotNull()),
        # a short word with any spelling of its own, or none, needs to be one that stands for itself
        Rule("short_word", ALLOW, short & ~anchor & (c("image") == goal) & autonomous & F.when(known, known_in_context).otherwise(exact)),
        Rule("known_in_context", ALLOW, fixed & known_in_context),
        Rule("forced_in_context", ALLOW, fixed & english & (c("layout_script") == "Latin") & c("new_known") & (freq >= FORCED) & (anchor | c("strong_ru"))),
        Rule("known_word", KEEP, fixed),
        Rule("alias", ALLOW, russian & (c("alias") == goal)),
        Rule("other_alias", WAIT, russian & c("alias").isNotNull()),
        Rule("not_the_image", WAIT, c("image") != goal),
        Rule("technical_word", ALLOW, russian & F.length(goal).between(3, 4) & K.is_technical_word(goal) & good & (freq >= TECHNICAL) & (c("p_goal") >= P_TECHNICAL) & (c("p_typed") < P_RUSSIAN)),
        Rule("anchored_rare_word", ALLOW, english & (c("layout_script") == "Latin") & anchor & ~c("own_known") & good & (freq >= ANCHORED) & (freq < FREQUENT)),
        Rule("spelling_rivals", WAIT, ambiguous & (c("n_sources") >= 1) & ~anchor),
        Rule("unknown_short_name", WAIT, tech_shape & ~named),
        Rule("reverse_image", ALLOW, english & ~c("own_known") & (F.length(low) <= LONGEST_IMAGE) & (c("p_typed") < P_ENGLISH) & good & (freq >= FREQUENT) & no_rivals),
        Rule("strong_source", KEEP, c("own_known") & (c("own_freq") >= FREQUENT) & ~named_anchor),
        Rule("frequent_image", ALLOW, russian & c("new_known") & (freq >= FREQUENT) & no_rivals),
        Rule("strong_image", ALLOW, russian & (F.length(goal) >= 3) & good & (freq >= FORCED) & (c("p_goal") >= P_STRONG) & ((c("p_typed") < P_RUSSIAN) | (tech_shape & named)) & ambiguous & (c("n_sources") == 0)),
        Rule("named_anchor", ALLOW, tech_shape & named & named_anchor),
        Rule("other_spelling", WAIT, unique & (c("target") != goal) & clash),
        Rule("discarded_rival", WAIT, unique & c("rival")),
        Rule("no_spelling", WAIT, ambiguous & (c("n_sources") == 0) & ~anchor & ~named_anchor),
        Rule("unknown_short_target", WAIT, tech_shape & ~c("new_known")),
        Rule("weak_target", WAIT, ~(c("new_known") & (freq >= FREQUENT))),
        Rule("known_in_target", WAIT, c("cross_known")),
        # keys map one to one, so no other word has the same image
        Rule("image", ALLOW, F.lit(True)),
    ]


# fixed values: endings that lack a soft sign
_SOFT_ENDINGS = "(?i)(еш|ост)$"


def lacks_soft_sign(word: Column) -> Column:
    return (F.length(word) >= 3) & word.rlike(_SOFT_ENDINGS)


def spelling_facts(proposals: DataFrame, dictionary: DataFrame, analysis: DataFrame) -> DataFrame:
    """The facts that spelling rules speak of, for ``proposals(token, replacement, lang, ...)``. Common slips count if the dictionary has their word."""
    t, r, lang = F.col("token"), F.col("replacement"), F.col("lang")
    table = _dictionary(dictionary)
    slips = {k: F.try_element_at(K.slip_map(k), F.lower("token")) for k in ("en", "ru")}
    rows = proposals.withColumns({"low": F.lower("token"), "goal": F.lower("replacement"), "slip": F.when(lang == "en", slips["en"]).when(lang == "ru", slips["ru"])})
    rows = _with_entry(_with_entry(_with_entry(rows, table, t, lang, "own"), table, r, lang, "new"), table, F.col("slip"), lang, "slip")
    rows = rows.withColumn("image", F.lower(layout_image(F.col("low"), lang)))
    rows = _with_entry(rows, table, F.col("image"), _other(lang), "image")
    seen = analysis.select(F.col("token").alias("low"), "lang", "class", "target", "n_sources", "rival", "safe")
    return rows.join(seen, ["low", "lang"], "left")


def spelling_rules() -> list[Rule]:
    """Rules for a replacement in the token's own language."""
    c = F.col
    low, goal, freq = c("low"), c("goal"), c("new_freq")
    soft = (c("lang") == "ru") & lacks_soft_sign(low)
    # the image competes where it has the letters of the replacement
    crossed = (freq >= SAFE) & c("image_known") & (c("image") != low) & (c("image") != goal) & (c("image_freq") >= F.greatest(F.lit(FREQUENT), freq - NEAR_FREQ)) & (T.script(c("image")) == T.script(goal))
    return [
        _nothing_to_do(),
        Rule("no_language", KEEP, c("lang").isNull()),
        Rule("common_slip", ALLOW, c("slip_known") & (c("slip") == goal)),
        Rule("other_slip", WAIT, c("slip_known")),
        Rule("known_word", KEEP, (c("own_known") | c("own_never")) & ~soft),
        Rule("soft_sign", ALLOW, soft & (goal == F.concat(low, F.lit("ь"))) & c("new_known") & (freq >= SOFT_SIGN)),
        Rule("not_unique", WAIT, F.coalesce((c("class") != "Unique") | (c("target") != goal), F.lit(True))),
        Rule("discarded_rival", WAIT, c("rival")),
        Rule("unsafe", WAIT, ~c("safe")),
        Rule("other_operation", WAIT, crossed),
        Rule("unique_source", ALLOW, F.lit(True)),
    ]


def layout_decisions(proposals: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token, replacement, lang, verdict, rule of each row of ``proposals(token, replacement, lang, strong_ru, strong_en, some_en)`` against
    ``dictionary(word, lang, freq, never, user)``. Repeated proposals are answered as often; a null token, replacement or language is left as it is."""
    table, proposals = _dictionary(dictionary), stored(proposals, "proposals")
    rows = layout_facts(proposals, table, _analysed(proposals, table))
    return rows.select("token", "replacement", "lang", first_match(layout_rules()).alias("d")).select("token", "replacement", "lang", "d.verdict", "d.rule")


def spelling_decisions(proposals: DataFrame, dictionary: DataFrame) -> DataFrame:
    """As layout_decisions, for ``proposals(token, replacement, lang)`` in the token's own language."""
    table, proposals = _dictionary(dictionary), stored(proposals, "proposals")
    rows = spelling_facts(proposals, table, _analysed(proposals, table))
    return rows.select("token", "replacement", "lang", first_match(spelling_rules()).alias("d")).select("token", "replacement", "lang", "d.verdict", "d.rule")


def combined_decisions(proposals: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token, replacement, lang, verdict, rule of ``proposals(token, replacement, lang)`` whose replacement spells what the token's keys give on the
    other layout. A replacement that is the image itself is judged by the layout rules; the rest by rules of its own, then by the spelling rules of the image."""
    lang, t, r = F.col("lang"), F.col("token"), F.col("replacement")
    table, proposals = _dictionary(dictionary), stored(proposals.select("token", "replacement", "lang"), "proposals")
    rows = stored(proposals.distinct(), "pairs")
    image = layout_image(t, lang)
    plain = F.coalesce(F.lower(image) == F.lower(r), F.lit(False))
    no = F.lit(False)
    direct = layout_decisions(rows.filter(plain).select("token", "replacement", "lang", no.alias("strong_ru"), no.alias("strong_en"), no.alias("some_en")), table)
    rest = rows.filter(~plain).withColumn("image", image)
    spelled = rest.filter("image is not null").select(F.col("image").alias("token"), "replacement", _other(lang).alias("lang")).distinct()
    judged = spelling_decisions(spelled, table).select(F.col("token").alias("image"), "replacement", _other(F.col("lang")).alias("lang"), F.struct("verdict", "rule").alias("spelling"))
    rest = _with_entry(_with_entry(rest, table, t, lang, "own"), table, r, K.token_language(r), "new").join(judged, ["image", "replacement", "lang"], "left")
    service = K.service_word(t)
    fixed = (F.col("own_known") | ((lang == "ru") & F.col("own_never"))) & ~F.coalesce((lang == "en") & (service["target"] == "ru"), F.lit(False))
    rules = [
        _nothing_to_do(),
        Rule("no_language", KEEP, lang.isNull()),
        Rule("no_image", KEEP, F.col("image") == t),
        Rule("known_word", KEEP, fixed),
        Rule("known_replacement", WAIT, ~K.is_layout_anchor(t) & (F.col("new_known") | F.col("new_never"))),
    ]
    own = first_match(rules, verdict="spelling")
    rest = rest.withColumn("d", own).withColumn("d", F.when(F.col("d.verdict") == "spelling", F.col("spelling")).otherwise(F.col("d")))
    answers = direct.unionByName(rest.select("token", "replacement", "lang", "d.verdict", "d.rule"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("token", "replacement", "lang")]
    kept = answers.select(*[F.col(c).alias(f"_{c}") for c in ("token", "replacement", "lang")], "verdict", "rule")
    return proposals.select("token", "replacement", "lang").join(kept, same, "left").select("token", "replacement", "lang", "verdict", "rule")
