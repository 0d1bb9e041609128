"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources share all words by weight; a source is clamped where its share exceeds ``max_epochs`` times its
size, and the excess goes to the others by weight. The fixed point of these rounds is found at
once: ordered by cap over weight, the clamped sources are a prefix, and running sums give the level.

Each source is then repeated a whole number of times, plus a seeded part. From every size of document the part takes the
same share of words, from the largest size down; what cannot be met in whole documents is carried on to the next smaller size, so
that the smallest documents bring the total to its target. Which documents of a size are taken follows a pseudo-random order: those
before a boundary, which is found from counts over 4,096 slices of that order, then over 4,096 slices of the slice it
lies in, until about 64 documents are left to be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import workspace

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
#: Slices of an order, or of one of its slices, and documents that need no more slices.
SLICES, FEW = 4096, 64
#: Places of the order.
PLACES = 1 << 52
#: Rows up to which tables of sources, or of sizes of sources, are sent to all executors.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\x09-\\x0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def source_plan(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """src, source_size, target, whole and part (words of the last, partial repetition) of each
    of ``sizes(src, source_size)``. One row per source is ordered in one task, nothing more."""
    ordered = Window.orderBy(F.col("src").isNull(), F.col("src").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    level_order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").isNull(), F.col("src").cast("binary"))
    everything = Window.partitionBy()
    table = sizes.withColumn("weight", weight).withColumn("cap", cap)
    # for a source in this order: what is left if all before it are clamped, shared by the weights from it on
    table = table.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    before = level_order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("level", left / share).withColumn("place", F.row_number().over(level_order))
    free = F.col("cap") / F.col("weight") >= F.col("level")
    table = table.withColumn("fixed", F.min(F.when(free, F.struct("place", "level"))).over(everything)["level"])
    target = F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("fixed")))
    table = table.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    table = table.withColumn("whole", whole)
    part = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    return table.select("src", "source_size", "target", "whole", part.alias("part"))


def _small(df: DataFrame) -> DataFrame:
    """A materialized table, broadcast if it is counted to be small."""
    return F.broadcast(df) if len(df.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) <= BROADCAST_ROWS else df


def size_plan(groups: DataFrame) -> DataFrame:
    """src, size, n, wanted: how many of the n documents of each size of ``groups(src, size, n, share)`` the part takes.

    Sizes are gone through from the largest: each takes the share of its words and what is carried over, rounded to whole documents. What
    is still missing then is filled from the largest size that fits, and at last by the smallest document left if that comes
    nearer. A source's sizes, at most as many as its largest document has words, meet in one row.
    """
    sizes = groups.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"), F.first("share").alias("share"))
    some = F.array().cast("array<struct<size:long,n:long,wanted:long>>")
    entry = lambda d, n: F.array(F.struct(d["size"].alias("size"), d["n"].alias("n"), n.cast("long").alias("wanted")))

    def diffuse(acc, d):
        want = acc["left"] + F.col("share") * d["size"] * d["n"]
        n = F.least(F.greatest(F.round(want / d["size"]), F.lit(0.0)), d["n"].cast("double"))
        return F.struct((want - n * d["size"]).alias("left"), F.concat(acc["rows"], entry(d, n)).alias("rows"))

    def fill(acc, d):
        n = F.least(F.greatest(F.floor(acc["left"] / d["size"]), F.lit(0)), d["n"] - d["wanted"])
        return F.struct((acc["left"] - n * d["size"]).alias("left"), F.concat(acc["rows"], entry(d, d["wanted"] + n)).alias("rows"))

    start = lambda left: F.struct(left.alias("left"), some.alias("rows"))
    plan = workspace.materialize(sizes.select("src", F.aggregate("sizes", start(F.lit(0.0)), diffuse).alias("got")), "diffused")
    plan = workspace.materialize(plan.select("src", F.aggregate("got.rows", start(F.col("got.left")), fill).alias("got")), "filled")
    rows = plan.select("src", F.col("got.left").alias("left"), F.explode("got.rows").alias("d"))
    rows = rows.withColumn("least", F.min(F.when(F.col("d.wanted") < F.col("d.n"), F.col("d.size"))).over(Window.partitionBy("src")))
    last = F.coalesce((F.col("d.size") == F.col("least")) & (F.col("d.size") < 2 * F.col("left")), F.lit(False)).cast("long")
    return rows.select("src", "d.size", "d.n", (F.col("d.wanted") + last).alias("wanted"))


def _boundaries(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """s, z, low, high, room: of the documents of source s and size z those before place low are taken, and room of those before high."""
    state = plan.select(F.col("src").alias("s"), F.col("size").alias("z"), F.when(F.col("wanted") == F.col("n"), PLACES).otherwise(0).cast("long").alias("low"), F.lit(PLACES).alias("high"), F.col("wanted").alias("room"), (F.col("wanted").between(1, F.col("n") - 1)).alias("open"))
    state = workspace.materialize(state, "places")
    width = PLACES
    while most > FEW and width > 1:
        most, width = most // SLICES, width // SLICES
        inside = rows.join(_small(state.filter("open")), _same("src", "s") & (F.col("size") == F.col("z"))).filter(F.col("u").between(F.col("low"), F.col("high") - 1))
        counts = inside.groupBy("s", "z", F.expr(f"(u - low) div {width}").alias("slice")).agg(F.count(F.lit(1)).alias("k"), F.first("low").alias("low"), F.first("room").alias("room"))
        before = F.sum("k").over(Window.partitionBy("s", "z").orderBy("slice")) - F.col("k")
        edge = counts.withColumn("before", before).filter((F.col("before") < F.col("room")) & (F.col("room") <= F.col("before") + F.col("k")))
        low = F.col("low") + F.col("slice") * width
        edge = edge.select("s", "z", low.alias("low"), (low + width).alias("high"), (F.col("room") - F.col("before")).alias("room"), F.lit(True).alias("open"))
        state = workspace.materialize(state.filter("not open").unionByName(edge), "places")
    return state


def _placed(docs: DataFrame, seed: int) -> DataFrame:
    """The rows of docs, and _lx_src, _lx_size and _lx_u: their source, their words, and their place in the pseudo-random order."""
    out = docs.withColumns({"_lx_src": F.col("source").cast("string"), "_lx_size": word_count(F.col("text").cast("string"))})
    return out.withColumn("_lx_u", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "_lx_size"), F.lit(PLACES)))


def _planned(docs: DataFrame, weights: tuple[float, ...], max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of docs without their texts, the plan of its sources, and the boundaries of the sizes of each source."""
    base = _placed(docs, seed).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_lx_src").alias("src"), F.col("_lx_size").alias("size"), F.monotonically_increasing_id().alias("row"), F.col("_lx_u").alias("u"))
    table = workspace.materialize(base, "mix")
    groups = workspace.materialize(table.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sizes = groups.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = workspace.materialize(source_plan(sizes, weights, max_epochs), "plan")

    parts = plan.filter("part > 0").select(F.col("src").alias("s"), (F.col("part") / F.col("source_size")).alias("share"))
    wanted = workspace.materialize(size_plan(groups.filter("size > 0").join(_small(parts), _same("src", "s")).drop("s")), "wanted")
    most = wanted.filter(F.col("wanted").between(1, F.col("n") - 1)).agg(F.max("n")).first()[0] or 0
    return table, plan, _boundaries(table, wanted, most)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``docs(doc_id, text, source, ...)``.

    Sources in code point order, null last, have the weights in turn. taken = copies * size words.
    copies differs by one at most within a source, never exceeds max_epochs, and is the same in every
    run. Null and wordless texts have size 0, and take nothing; a source without words has target 0.
    Equal rows are separate documents. An empty table gives no rows; other columns are ignored.
    """
    table, plan, bounds = _planned(docs, weights, max_epochs, seed)
    rows = table.join(_small(plan.select(F.col("src").alias("s"), "source_size", "target", "whole")), _same("src", "s"), "left").drop("s")
    rows = rows.join(_small(bounds), _same("src", "s") & (F.col("size") == F.col("z")), "left").drop("s", "z")
    edge = F.coalesce(F.col("open") & F.col("u").between(F.col("low"), F.col("high") - 1), F.lit(False))
    order = Window.partitionBy("src", "size").orderBy("u", "row")
    zone = rows.filter(edge).withColumn("extra", F.row_number().over(order) <= F.col("room"))
    out = rows.filter(~edge).withColumn("extra", F.coalesce(F.col("u") < F.col("low"), F.lit(False))).unionByName(zone)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("long")).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _cuts(table: DataFrame, bounds: DataFrame) -> DataFrame:
    """s, z, low, room: of the documents of source s and size z those before place low are taken, and room of several that lie at it."""
    inside = table.join(_small(bounds.filter("open")), _same("src", "s") & (F.col("size") == F.col("z"))).filter(F.col("u").between(F.col("low"), F.col("high") - 1))
    counts = inside.groupBy("s", "z", "u").agg(F.count(F.lit(1)).alias("k"), F.first("room").alias("room"))
    left = F.col("room") - (F.sum("k").over(Window.partitionBy("s", "z").orderBy("u")) - F.col("k"))
    edge = counts.withColumn("left", left).filter(F.col("left").between(1, F.col("k")))
    all_ = F.col("left") == F.col("k")
    edge = edge.select("s", "z", (F.col("u") + all_.cast("long")).alias("low"), F.when(all_, 0).otherwise(F.col("left")).alias("room"))
    return bounds.filter("not open").select("s", "z", "low", F.lit(0).cast("long").alias("room")).unionByName(edge)


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """Every row of ``docs``, as it is, as often as ``mix_sources`` takes it.

    Where a source's size is cut is looked up by source and size, so that a row is judged where it lies and texts are not shuffled (but
    beyond BROADCAST_ROWS sizes of sources). Of rows that share source, size and place (so, doc_id) at the cut, the first by text are taken.
    """
    table, plan, bounds = _planned(docs, weights, max_epochs, seed)
    cuts, seen = workspace.observed(_cuts(table, bounds), "cuts", F.count_if(F.col("room") > 0).alias("shared"))
    rows = _placed(docs, seed)
    rows = rows.join(_small(plan.select(F.col("src").alias("_lx_s"), F.col("whole").alias("_lx_whole"))), _same("_lx_src", "_lx_s"), "left").drop("_lx_s")
    rows = rows.join(_small(cuts.toDF("_lx_s", "_lx_z", "_lx_low", "_lx_room")), _same("_lx_src", "_lx_s") & (F.col("_lx_size") == F.col("_lx_z")), "left")
    before = F.coalesce(F.col("_lx_u") < F.col("_lx_low"), F.lit(False))
    out = rows.withColumn("_lx_extra", before)
    if seen["shared"]:
        at = F.coalesce((F.col("_lx_u") == F.col("_lx_low")) & (F.col("_lx_room") > 0), F.lit(False))
        order = Window.partitionBy("_lx_src", "_lx_size", "_lx_u").orderBy(F.col("doc_id").cast("long"), "text")
        out = out.filter(~at).unionByName(rows.filter(at).withColumn("_lx_extra", F.row_number().over(order) <= F.col("_lx_room")))
    copies = F.when(F.col("_lx_size") > 0, F.col("_lx_whole") + F.col("_lx_extra").cast("long")).otherwise(F.lit(0)).cast("int")
    out = out.withColumn("_lx_copies", copies).filter("_lx_copies > 0")
    return out.withColumn("_lx_copy", F.explode(F.sequence(F.lit(1), F.col("_lx_copies")))).select(*docs.columns)
