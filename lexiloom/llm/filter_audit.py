"""How filters interact: Walsh-Hadamard sums of failure masks, every order of the filters, and Shapley values.

Each document has a mask of the filters that it fails. For each part and label the table is read into 32 signed sums,
one for each set s of filters: the sum of (-1)^|mask & s|. Five rounds of butterflies and a division by 32 give back the number of
documents with each mask, exactly. All orders and steps are then evaluated over 32 numbers of a part, never over documents. A
document failing f filters is removed by each of them in 120 / f of the orders, which gives the Shapley values in closed form.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import workspace

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 50, 65, 5
WORD, UPPER, SYMBOL = r"[^\x20\x09-\x0D]+", "[A-Z]", "[#$%&*|]"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row of ``docs(doc_id, text, source, ...)``: bit i is set if filter i of ABCDE fails.

    Null texts are empty, null sources the part ''. A text is a repetition if a row with a smaller doc_id has the same text (by its SHA-256);
    rows of one doc_id do not repeat one another, and a null doc_id neither repeats nor is repeated.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [
        F.size("words") < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT_PERCENT * F.size("words"),
        100 * F.regexp_count("text", F.lit(UPPER)).cast("long") > MOST_UPPER_PERCENT * F.length("text"),
        F.col("text").rlike(SYMBOL),
    ]
    mask = sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))
    rows = workspace.materialize(rows.select("doc_id", "part", mask.alias("own"), F.unhex(F.sha2("text", 256)).alias("key")), "failures")
    # only texts that several rows hold are joined; a text that a third of all rows holds is one row of this side
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << 4)
    return rows.join(first, "key", "left").select("doc_id", "part", (F.col("own") + again).alias("mask"))


def parity_sums(masks: DataFrame, by: list[str]) -> DataFrame:
    """by, walsh: the 32 signed sums of ``masks(mask, *by)``, in order of their sets."""
    signs = [F.sum(1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)).cast("long").alias(f"w{s}") for s in range(CELLS)]
    return masks.groupBy(*by).agg(*signs).select(*by, F.array(*[f"w{s}" for s in range(CELLS)]).alias("walsh"))


def invert(walsh: Column) -> Column:
    """Number of documents with each mask: butterflies over one bit after another, then an exact division."""
    bits = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    butterfly = lambda a, bit: F.transform(a, lambda x, i: F.when(i.bitwiseAND(bit) == 0, x + F.get(a, i + bit)).otherwise(F.get(a, i - bit) - x))
    walsh = F.aggregate(bits, walsh, butterfly)
    return F.transform(walsh, lambda x: F.shiftright(x, len(FILTERS)))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows per part.

    ``labels(doc_id, quality, toxic, ...)``: a doc_id with several rows is good (toxic) if one of them says so; null labels and rows without
    labels count as neither. An empty table of documents gives no rows, an empty table of labels zeros. Repeated rows count as
    often as they are there; other columns are ignored.
    """
    mark = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("lid")).agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    rows = failures(docs).join(marks, F.col("doc_id") == F.col("lid"), "left").na.fill(0, ["good", "toxic"])
    sums = workspace.materialize(parity_sums(rows, ["part", "good", "toxic"]), "parity")
    cells = sums.select("part", "good", "toxic", F.posexplode(invert(F.col("walsh"))).alias("mask", "n"))
    counts = {"n": F.sum("n"), "good": F.sum(F.col("n") * F.col("good")), "toxic": F.sum(F.col("n") * F.col("toxic"))}
    cells = cells.groupBy("part", "mask").agg(*[c.alias(name) for name, c in counts.items()])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *counts)).alias("cells"))  # 32 of a part

    steps = parts.select("part", "cells", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order"))
    steps = steps.select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))
    letters = F.split(F.substring("filter_order", 1, F.col("step") - 1), "")
    earlier = F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda acc, x: acc.bitwiseOR(bit_of(x)))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumns({"bit": bit_of(F.col("filter")), "earlier": earlier})

    bit, before = F.col("bit"), F.col("earlier")
    meets = lambda c, s: c["mask"].bitwiseAND(s) != 0
    here = lambda c: meets(c, bit) & ~meets(c, before)
    total = lambda test, value=lambda c: c["n"]: F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda acc, c: acc + value(c))
    share = lambda c: c["n"] * F.expr(f"array({', '.join(str(len(ORDERS) // max(1, k)) for k in range(6))})")[F.bit_count(c["mask"])]
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        "filter",
        total(lambda c: ~meets(c, bit) & ~meets(c, before)).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: meets(c, bit) & meets(c, before)).alias("redundant"),
        total(lambda c: c["mask"] == bit).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda c: meets(c, bit), share).alias("shapley"),
    )
