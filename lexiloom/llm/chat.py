"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is written as ``<turn ROLE>BODY</turn>`` and a newline. In roles and texts the characters \\, < and >
become \\b, \\l and \\g, so no text can hold a mark, and three plain replacements undo it. The visitor of
parts writes text as it is and every other part as ``<KIND n>``, n counting the conversation's attachments
from 1; attachments keep kind, reference and the number of tokens that the placeholder expands to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that an attachment expands to where the part gives none.
EXPANDED_TOKENS = {"image": 576, "audio": 750, "document": 1024}
PARTS = "array<struct<kind: string, text: string, ref: string, tokens: bigint>>"


def escape(text: Column) -> Column:
    for raw, mark in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for raw, mark in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def text_parts(text: Column) -> Column:
    """A single text part; null text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))).cast(PARTS)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask, attachments, expanded_tokens for each conversation of
    ``turns(conv_id, turn, role, text | parts, ...)``.

    Turns are ordered by turn (null first), then role, then body; rows that agree in all are all kept. Null roles and
    texts are empty; null parts and null kinds are text. loss_mask lists (turn index from 0, start, length) of the
    bodies of loss_role, in code points within the written turn. A null conv_id is a conversation of its own. No rows
    give no rows; other columns are ignored.
    """
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)) if "parts" in turns.columns else text_parts(F.col("text").cast("string"))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("files", F.filter("parts", lambda p: ~_is_text(p)))
    # the order must not depend on numbers that follow from it
    key = F.array_join(F.transform("parts", lambda p: F.concat_ws("\x01", F.coalesce(p["kind"], F.lit("text")), F.coalesce(p["text"], F.lit("")), F.coalesce(p["ref"], F.lit("")))), "\x02")
    rows = rows.withColumn("key", key)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("seen", F.coalesce(F.sum(F.size("files")).over(running), F.lit(0)))
    written = F.transform(
        "parts",
        lambda p, i: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<"), escape(p["kind"]), F.lit(" "), (F.col("seen") + F.size(F.filter(F.slice("parts", 1, i + 1), lambda q: ~_is_text(q)))).cast("string"), F.lit(">"))
        ),
    )
    rows = rows.withColumn("body", F.array_join(written, "")).withColumn("head", F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">")))
    known = lambda f: F.coalesce(f["tokens"], *[F.when(f["kind"] == k, F.lit(n).cast("bigint")) for k, n in EXPANDED_TOKENS.items()], F.lit(0).cast("bigint"))
    files = F.transform("files", lambda f: F.struct(f["kind"].alias("kind"), f["ref"].alias("ref"), known(f).alias("tokens")))
    mask = F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("turn"), F.length("head").alias("start"), F.length("body").alias("length")))
    turn = F.struct(F.col("at"), F.concat("head", "body", F.lit("</turn>\n")).alias("written"), files.alias("files"), mask.alias("mask"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: t["files"]))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["mask"]), lambda m: m.isNotNull()).alias("loss_mask"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    inner = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")
    close = lambda p: F.instr(p, ">")
    return F.transform(inner, lambda p: F.struct(unescape(p.substr(F.lit(7), close(p) - 7)).alias("role"), unescape(p.substr(close(p) + 1, F.length(p))).alias("text")))


def read_parts(formatted: Column) -> Column:
    """The (role, parts) turns of a formatted conversation, parts being (kind, text, n): texts as they were given, joined where they touch,
    and placeholders with the number of their attachment. A placeholder's mark in a user's own text stays text; an empty text has no part."""
    inner = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")
    close = lambda p: F.instr(p, ">")
    pieces = lambda body: F.filter(F.split(body, "(?=<)|(?<=>)", -1), lambda x: x != "")
    mark = "^<(.*) ([0-9]+)>$"
    part = lambda x: F.when(
        x.startswith("<"), F.struct(unescape(F.regexp_extract(x, "(?s)" + mark, 1)).alias("kind"), F.lit(None).cast("string").alias("text"), F.regexp_extract(x, "(?s)" + mark, 2).cast("int").alias("n"))
    ).otherwise(F.struct(F.lit("text").alias("kind"), unescape(x).alias("text"), F.lit(None).cast("int").alias("n")))
    return F.transform(inner, lambda p: F.struct(unescape(p.substr(F.lit(7), close(p) - 7)).alias("role"), F.transform(pieces(p.substr(close(p) + 1, F.length(p))), part).alias("parts")))


def read_loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    turns = F.split(formatted, "(?<=</turn>\n)", -1)
    return F.array_join(F.transform(mask, lambda m: unescape(F.get(turns, m["turn"]).substr(m["start"] + 1, m["length"]))), "")
