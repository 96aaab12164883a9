"""Chat formatting in Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one
role are merged into one block by slices of that array, and blocks are
concatenated; the places of texts come from running sums over the sorted rows,
so the work grows with the turns of a conversation, not with their square:

    <|im_start|>role NEWLINE text [<|im_sep|>text ...]<|im_end|> NEWLINE

Control strings inside texts are escaped reversibly: every ``<``, backslashes,
``|`` gains one backslash, so ``<|`` never stands in an escaped text.  Roles
escape ``%``, newline and ``<`` by percent codes.  ``<|im_sep|>`` keeps the
boundary of merged turns, so reading back loses nothing.

Defined results: a null text is an empty one, a null role is an empty one; ties
in ``turn`` go by role, then text; repeated rows are repeated turns; a null
conversation id is a conversation of its own; an empty table gives no rows;
further columns are ignored.  The formatted text of a conversation is one value,
as wide as the conversation itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation.

    ``loss_spans`` are code point offsets (start, end exclusive) of the texts of
    ``loss_role`` in ``formatted``, in order.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("raw"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    rows = rows.withColumn("before", F.lag("role").over(order)).withColumn("text", escape_text(F.col("raw")))
    opened = F.lit(len(START)) + F.length(escape_role(F.col("role"))) + 1
    lead = F.when(F.col("before").isNull(), opened).when(F.col("before") == F.col("role"), F.lit(len(SEP))).otherwise(opened + len(END))
    rows = rows.withColumn("end", F.sum(lead + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    turn = F.struct("turn", "role", "raw", "end", "text", F.coalesce(F.col("before") == F.col("role"), F.lit(False)).alias("joins"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("ts"))
    # the places (from 1) at which a block of one role begins, and one place past the last turn
    begins = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: ~F.element_at(F.col("ts"), i)["joins"])
    placed = sorted_turns.withColumn("at", F.concat(begins, F.array(F.size("ts") + 1)))

    def block(i: Column, k: Column) -> Column:
        block_turns = F.slice("ts", i, F.element_at(F.col("at"), k + 2) - i)
        texts = F.array_join(F.transform(block_turns, lambda t: t["text"]), SEP)
        return F.concat(F.lit(START), escape_role(block_turns[0]["role"]), F.lit("\n"), texts, F.lit(END))

    formatted = F.array_join(F.transform(F.slice("at", 1, F.size("at") - 1), block), "")
    said = F.filter("ts", lambda t: t["role"] == loss_role)
    spans = F.transform(said, lambda t: F.struct((t["end"] - F.length(t["text"])).alias("start"), t["end"].alias("end")))
    return placed.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text), read back from ``formatted`` and ``loss_spans`` alone."""
    parts = F.split("formatted", r"<\|im_start\|>")
    blocks = F.slice(parts, 2, F.size(parts) - 1)
    head = lambda b: F.substring_index(b, "\n", 1)
    body = lambda b: F.substring(b, F.length(head(b)) + 2, F.length(b) - F.length(head(b)) - 1 - len(END))
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(F.split(body(b), r"<\|im_sep\|>", -1), lambda x: F.struct(unescape_role(head(b)).alias("role"), unescape_text(x).alias("text"))),
        )
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape_text(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def digest(parsed: DataFrame) -> DataFrame:
    """One digest row a conversation of :func:`parse_chats`."""
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
