"""Word forms by affix rules: reading rule files, generating the forms of roots, and finding the roots of forms by joins.

A rule strips letters from one end of a root, if that end fits a condition, and appends others. Rules are rows; roots carry the flags of
the rules that they take. Generating joins roots with rules on the flag. Analysing joins the endings (beginnings) of a token
with what rules append, puts the stripped letters back, and joins the result with the roots: no form has to be generated, and both joins
are on equal strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import candidates as C

PREFIX, SUFFIX = "PFX", "SFX"
#: How flags are written: one character each, two, or numbers between commas.
FLAG_KINDS = ("char", "long", "num")


def split_flags(flags: Column, kind: str = "char") -> Column:
    """The flags of an entry as an array; empty for null."""
    parts = {"char": F.split(flags, ""), "long": F.regexp_extract_all(flags, F.lit("(..)"), F.lit(1)), "num": F.split(flags, ",")}[kind]
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: F.trim(x) != "")), F.array().cast("array<string>"))


def affix_rules(lines: DataFrame) -> DataFrame:
    """kind, flag, cross, strip, append, condition of the ``lines(value)`` of an affix file. Lines may come in any order.

    A header line says whether prefixes and suffixes of a flag go together; 0 stands for nothing, flags after a slash in what is
    appended are cut, the condition . holds everywhere. Comments and other settings are passed over; a rule without a header is an error.
    """
    words = lines.select(F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ").alias("p")).filter(F.get("p", F.lit(0)).isin(PREFIX, SUFFIX))
    at = lambda i: F.get("p", F.lit(i))
    is_head = (F.size("p") >= 4) & at(2).isin("Y", "N") & at(3).rlike("^[0-9]+$")
    heads = words.filter(is_head).groupBy(at(0).alias("kind"), at(1).alias("flag")).agg(F.max(at(2) == "Y").alias("cross"))
    bare = lambda x: F.when(x == "0", "").otherwise(F.substring_index(x, "/", 1))
    rules = words.filter(~is_head).select(at(0).alias("kind"), at(1).alias("flag"), bare(at(2)).alias("strip"), bare(at(3)).alias("append"), F.coalesce(at(4), F.lit(".")).alias("condition")).distinct()
    append = F.when(F.col("append") == "0", "").otherwise(F.col("append"))
    known = F.when(F.col("cross").isNull(), F.raise_error(F.concat(F.lit("no header for rules of flag "), "flag"))).otherwise(F.col("cross"))
    return rules.join(F.broadcast(heads), ["kind", "flag"], "left").select("kind", "flag", known.alias("cross"), "strip", append.alias("append"), "condition")


def read_affix_file(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The rules of an affix file, and how it writes flags. The file must begin with its encoding (SET ...)."""
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    if not first or not first[0]["value"].lstrip("﻿").upper().startswith("SET "):
        raise ValueError(f"{path} does not begin with SET: not an affix file")
    said = lines.filter(F.col("value").rlike("^FLAG ")).select(F.lower(F.trim(F.substring("value", 6, 20))).alias("k")).limit(1).collect()
    kind = said[0]["k"] if said else "char"
    if kind not in FLAG_KINDS:
        raise ValueError(f"{path} writes flags as {kind!r}")
    return affix_rules(lines), kind


def read_entries(spark: SparkSession, path: str, flag_kind: str = "char") -> DataFrame:
    """word, flags of a dictionary file, whose first line must be the number of its entries. Words are lookup keys; flags of equal words are joined."""
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    if not first or not first[0]["value"].strip().isdigit() or int(first[0]["value"]) <= 0:
        raise ValueError(f"{path} does not begin with a number of entries: not a dictionary file")
    v = F.trim(F.substring_index("value", "\t", 1))
    rows = lines.select(v.alias("v")).filter("v != '' and not v rlike '^#' and not v rlike '^[0-9]+$'")
    flags = F.when(F.col("v").contains("/"), F.substring_index("v", "/", -1))
    rows = rows.select(T.lookup_key(F.substring_index("v", "/", 1)).alias("word"), split_flags(flags, flag_kind).alias("flags"))
    return rows.groupBy("word").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"))


def looks_like_pair(spark: SparkSession, dictionary: str, affixes: str) -> bool:
    """Whether two files are a dictionary and its affix rules, by their first lines."""
    heads = []
    for path in (dictionary, affixes):
        try:
            heads.append(spark.read.text(path).limit(1).collect())
        except Exception as e:  # a missing file is no pair; anything else is an error
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise
    count, setting = (h[0]["value"].strip() if h else "" for h in heads)
    return count.isdigit() and int(count) > 0 and setting.lstrip("﻿").upper().startswith("SET ")


def _fits(kind: str, word: Column) -> Column:
    """Whether the end (beginning) of a root fits the rule of the row, and what is left after stripping it."""
    if kind == SUFFIX:
        return word.endswith(F.col("strip")) & F.rlike(word, F.concat(F.lit("(?:"), "condition", F.lit(")$")))
    return word.startswith(F.col("strip")) & F.rlike(word, F.concat(F.lit("^(?:"), "condition", F.lit(")")))


def _add(kind: str, word: Column) -> Column:
    n = F.length("strip")
    if kind == SUFFIX:
        return F.concat(word.substr(F.lit(1), F.length(word) - n), F.col("append"))
    return F.concat(F.col("append"), word.substr(n + 1, F.length(word)))


def word_forms(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """word, form, prefix, suffix: every form of ``entries(word, flags)`` by one suffix, one prefix, or one of each where both say that they go together.
    The word itself is its first form; empty forms are left out."""
    marked = entries.select("word", F.explode("flags").alias("flag"))

    def one(kind: str) -> DataFrame:
        own = C.sized(rules.filter(F.col("kind") == kind))
        found = marked.join(own, "flag").filter(_fits(kind, F.col("word")))
        return found.select("word", _add(kind, F.col("word")).alias("form"), "flag", "cross")

    none = F.lit(None).cast("string")
    plain = entries.select("word", F.col("word").alias("form"), none.alias("prefix"), none.alias("suffix"))
    suffixed = one(SUFFIX)
    prefixes = marked.join(C.sized(rules.filter(F.col("kind") == PREFIX).withColumnRenamed("cross", "p_cross")), "flag")
    prefixed = one(PREFIX).select("word", "form", F.col("flag").alias("prefix"), none.alias("suffix"))
    both = suffixed.filter("cross").select("word", F.col("form").alias("base"), F.col("flag").alias("suffix"))
    both = prefixes.filter("p_cross").withColumnRenamed("flag", "prefix").join(both, "word").filter(_fits(PREFIX, F.col("base")))
    both = both.select("word", _add(PREFIX, F.col("base")).alias("form"), "prefix", "suffix")
    rows = plain.unionByName(suffixed.select("word", "form", none.alias("prefix"), F.col("flag").alias("suffix"))).unionByName(prefixed).unionByName(both)
    return rows.filter("form != ''").distinct()


def _strip(tokens: DataFrame, column: str, rules: DataFrame, kind: str, flag: str) -> DataFrame:
    """Rows of ``tokens`` with each rule of a kind undone: ``column`` becomes what the rule was applied to."""
    own = rules.filter(F.col("kind") == kind)
    longest = own.agg(F.coalesce(F.max(F.length("append")), F.lit(0))).first()[0]
    word = F.col(column)
    lengths = F.sequence(F.lit(0), F.least(F.length(word), F.lit(longest)))
    part = lambda n: F.when(n == 0, "").otherwise(F.right(word, n) if kind == SUFFIX else word.substr(F.lit(1), n))
    cut = tokens.withColumn("append", F.explode(F.transform(lengths, part))).join(C.sized(own), "append")
    n = F.length("append")
    base = F.concat(word.substr(F.lit(1), F.length(word) - n), F.col("strip")) if kind == SUFFIX else F.concat(F.col("strip"), word.substr(n + 1, F.length(word)))
    cut = cut.withColumn(column, base).filter(_fits(kind, F.col(column)))
    return cut.select(*tokens.columns, F.col("flag").alias(flag), F.col("cross").alias(f"{flag}_cross"))


def analyse(tokens: DataFrame, entries: DataFrame, rules: DataFrame) -> DataFrame:
    """token, root, prefix, suffix: every way in which a token of the distinct ``tokens(token)`` is a form of an entry. Tokens are read as lookup keys."""
    own = entries.select("word", "flags")
    rows = tokens.filter("token is not null and token != ''").select("token", T.lookup_key(F.col("token")).alias("word"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    suffixed = _strip(rows, "word", rules, SUFFIX, "suffix")
    blank = {f: [none.alias(f), no.alias(f"{f}_cross")] for f in ("prefix", "suffix")}
    plain = rows.select("token", "word", *blank["prefix"], *blank["suffix"])
    one = suffixed.select("token", "word", *blank["prefix"], "suffix", "suffix_cross")
    prefixed = _strip(rows, "word", rules, PREFIX, "prefix").select("token", "word", "prefix", "prefix_cross", *blank["suffix"])
    # the prefix was put on last, so it comes off first
    both = _strip(_strip(rows, "word", rules, PREFIX, "prefix").filter("prefix_cross"), "word", rules, SUFFIX, "suffix").filter("suffix_cross")
    found = plain.unionByName(one).unionByName(prefixed).unionByName(both.select(*plain.columns)).join(own, "word")
    carries = lambda f: F.col(f).isNull() | F.array_contains("flags", F.col(f))
    return found.filter(carries("prefix") & carries("suffix")).select("token", F.col("word").alias("root"), "prefix", "suffix").distinct()


def root_words(tokens: DataFrame, entries: DataFrame, rules: DataFrame) -> DataFrame:
    """token, root: one root of each token that is a form of another word: fewest affixes, then the longest, then the first root."""
    found = analyse(tokens, entries, rules).filter(T.lookup_key(F.col("token")) != F.col("root"))
    affixes = F.col("prefix").isNotNull().cast("int") + F.col("suffix").isNotNull().cast("int")
    order = Window.partitionBy("token").orderBy(affixes, F.desc(F.length("root")), "root")
    return found.withColumn("k", F.row_number().over(order)).filter("k = 1").select("token", "root")
