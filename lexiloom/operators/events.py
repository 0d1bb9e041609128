"""Ordered and grouped operators over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.candidates import sized

_ORDER = ("ts", "event_id")


def rolling_p95(events: DataFrame, frame: int = 256) -> DataFrame:
    """event_id, p95: element ceil(0.95 n) - 1 of the last ``frame`` values of the user; negative values count as 0."""
    over = Window.partitionBy("user_id").orderBy(*_ORDER).rowsBetween(1 - frame, 0)
    sample = F.sort_array(F.collect_list(F.greatest(F.col("value"), F.lit(0.0))).over(over))
    return events.withColumn("s", sample).select("event_id", F.get("s", F.ceil(F.size("s") * 0.95).cast("int") - 1).alias("p95"))


def duration_summary(events: DataFrame, key: str) -> DataFrame:
    v = F.greatest(F.col("value"), F.lit(0.0))
    return events.groupBy(key).agg(F.count("value").alias("n"), F.avg(v).alias("avg"), F.max(v).alias("max"), F.expr("percentile_disc(0.95) within group (order by greatest(value, 0.0))").alias("p95"))


def last_events(events: DataFrame, key: str, n: int = 50) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("back", F.row_number().over(order).cast("long")).filter(F.col("back") <= n)


def double_taps(events: DataFrame, gap_ms: int) -> DataFrame:
    """event_id, gap_ms of events that follow the user's last one of the same type within the gap."""
    order = Window.partitionBy("user_id", "event_type").orderBy(*_ORDER)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (micros - F.lag(micros).over(order)) / 1000
    return events.withColumn("gap_ms", gap).filter(F.col("gap_ms") <= gap_ms).select("event_id", "gap_ms")


def language_votes(tokens: DataFrame, script: Column, frame: int = 8, before: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, pos, en, ru, dominant over the last ``frame`` tokens (those before a token, if ``before``): a lead of two, or a majority of three.
    Columns ``keep`` of the tokens stay with them."""
    over = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1 - frame - before, -int(before))
    t = tokens.withColumn("s", script)
    t = t.withColumn("en", F.count_if(F.col("s") == "Latin").over(over)).withColumn("ru", F.count_if(F.col("s") == "Cyrillic").over(over))
    en, ru = F.col("en"), F.col("ru")
    dominant = F.when(ru >= F.greatest(en + 2, F.lit(2)), "ru").when(en >= F.greatest(ru + 2, F.lit(2)), "en").when((ru > en) & (ru >= 3), "ru").when((en > ru) & (en >= 3), "en")
    return t.select("doc_id", "pos", *keep, "en", "ru", dominant.alias("dominant"))


def safety_state(context: DataFrame, excluded: DataFrame) -> DataFrame:
    """id, state: the first rule that fits. excluded(app) are compared without case or outer blanks."""
    names = sized(excluded.select(F.lower(F.trim("app")).alias("x")).distinct())
    c = context.join(names, F.lower(F.trim("app")) == F.col("x"), "left")
    state = (
        F.when(~F.col("enabled"), "Disabled").when(F.col("paused"), "Paused").when(F.col("secure") == "yes", "SecureInput").when(F.col("secure") == "unknown", "UnknownContext")
        .when(F.col("x").isNotNull(), "ExcludedApplication").when(F.col("safe_mode"), "SafeMode").otherwise("Allowed")
    )
    return c.select("id", state.alias("state"))


def merge_rejections(rows: DataFrame) -> DataFrame:
    """One row per kind, candidate and replacement: undo counts add up, the latest known weight stays; suppressed from two undos."""
    latest = F.max_by("weight", F.when(F.col("weight").isNotNull(), F.col("seq")))
    out = rows.groupBy("kind", "candidate", "replacement").agg(F.sum("undo_count").alias("undo_count"), latest.alias("weight"))
    return out.withColumn("suppressed", F.col("undo_count") >= 2)


def last_entries(rows: DataFrame, cap: int = 8192) -> DataFrame:
    """lang, key, freq: the last entry of each lower-cased word; keys beyond the first ``cap`` of a language are dropped (the feature)."""
    r = rows.withColumn("key", F.lower(F.trim("word")))
    one = r.groupBy("lang", "key").agg(F.min("seq").alias("first"), F.max_by("freq", "seq").alias("freq"))
    return one.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("first"))).filter(F.col("k") <= cap).select("lang", "key", "freq")


def match_snippets(requests: DataFrame, snippets: DataFrame) -> DataFrame:
    """req_id, id of the best snippet: enabled, of the language or of none, by trigger (case as it says), with its deny list beating its allow list;
    language and app matches score, ties to the trigger and id. Joined on the lower-cased trigger."""
    r = requests.withColumn("k", F.lower("typed"))
    s = snippets.filter("enabled").withColumn("k", F.lower("trigger"))
    app = F.lower("app")
    has = lambda c: F.exists(c, lambda a: F.lower(a) == app)
    allowed = (F.size("apps_on") == 0) | (F.col("app").isNotNull() & has("apps_on"))
    fits = (F.col("slang").isNull() | (F.col("slang") == F.col("lang"))) & (~F.col("case_sensitive") | (F.col("typed") == F.col("trigger"))) & allowed & ~F.coalesce(has("apps_off"), F.lit(False))
    score = F.when(F.col("slang").isNotNull(), 2).otherwise(0) + F.when(F.size("apps_on") > 0, 1).otherwise(0)
    best = F.min(F.struct((-score).alias("score"), "trigger", "id"))
    return r.join(s, "k").filter(fits).groupBy("req_id").agg(best["id"].alias("id"))


def context_layout(tokens: DataFrame, lexicon: DataFrame, boost: float = 0.12) -> DataFrame:
    """doc_id, pos, candidate, confidence: Cyrillic tokens of ``tokens(doc_id, pos, token)`` that are words of ``lexicon(word, freq)``
    on the other layout, where the tokens before them speak for English."""
    # the token stays with its votes, so that rows are dealt once, and only those that are asked for meet the lexicon
    votes = language_votes(tokens.withColumn("script", T.script(F.col("token"))), F.col("script"), before=True, keep=("token", "script"))
    asked = votes.filter("script = 'Cyrillic' and (dominant = 'en' or (en >= 1 and ru = 0))")
    typed = asked.select("doc_id", "pos", T.to_english_layout(F.col("token")).alias("candidate"))
    found = typed.join(sized(lexicon.select(F.col("word").alias("key"), "freq")), F.lower("candidate") == F.col("key"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(0.97), 0.78 + F.col("freq") * 0.18 + boost))
    return found.select("doc_id", "pos", "candidate", confidence.alias("confidence"))


def duplicate_snippets(snippets: DataFrame) -> DataFrame:
    """id, first_id of snippets that repeat an earlier one: the same trigger without case, language, case rule, and application
    lists without case and order."""
    apps = lambda c: F.array_sort(F.transform(c, F.lower))
    key = [F.lower(F.trim("trigger")).alias("t"), F.coalesce("slang", F.lit("")).alias("l"), F.col("case_sensitive").alias("c"), apps("apps_on").alias("on"), apps("apps_off").alias("off")]
    keyed = snippets.select("id", *key)
    first = keyed.groupBy("t", "l", "c", "on", "off").agg(F.min("id").alias("first_id"))
    return keyed.join(first, ["t", "l", "c", "on", "off"]).filter("id <> first_id").select("id", "first_id")


def valid_entries(rows: DataFrame, longest: int = 256) -> DataFrame:
    """Rows of (word, freq, ...) with a word that is not blank, not too long and free of control characters, and a frequency in [0, 1] or none."""
    w = F.trim("word")
    return rows.filter((w != "") & (F.length(w) <= longest) & ~w.rlike(r"\p{Cntrl}") & (F.col("freq").isNull() | F.col("freq").between(0, 1)))


def process_names(lists: DataFrame, longest: int = 64) -> DataFrame:
    """id, names, n_errors of ``lists(id, text)``: entries between commas, semicolons and line ends, without blanks around and .exe;
    the first spelling of each valid name stays, names that are no plain process names are errors. Null texts have none of either."""
    entries = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[,;\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    bare = F.transform(entries, lambda x: F.regexp_replace(x, r"(?i)\.exe$", ""))
    rows = lists.select("id", bare.alias("bare"))
    ok = F.filter("bare", lambda x: x.rlike(f"^[A-Za-z0-9._-]{{1,{longest}}}$"))
    rows = rows.withColumn("ok", ok).withColumn("low", F.transform("ok", F.lower))
    first = F.filter("ok", lambda x, i: F.array_position("low", F.lower(x)) == i + 1)
    return rows.select("id", first.alias("names"), (F.size("bare") - F.size("ok")).alias("n_errors"))
