"""Chat formatting by prefix-target expansion, in Spark SQL functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
text is trainable. A conversation whose last turn is not an assistant's gets one more example
without a target, so that the output holds every turn.

A turn is ``<s>[ROLE]role[/ROLE]text</s>``. In roles and texts each of ``\\ < > [ ]`` is preceded
by a backslash, so no marker can occur inside a text, and removing the backslashes gives it back.

Null roles and texts count as empty, null turns sort first, rows that share a turn are ordered by
role and text. Rows without a conversation id form one conversation. Columns beyond the four that
are named are ignored. An empty table gives an empty result.

A conversation is assembled in one row, since each of its examples has to hold its whole prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\<>\[\]])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN + ROLE), escape(turn["role"]), F.lit(ROLE_END))


def _render(turn: Column) -> Column:
    return F.concat(_head(turn), escape(turn["text"]), F.lit(END))


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: ``conv_id``, ``example`` (place of its last turn, from 1), ``is_last``,
    ``formatted``, and the trainable span ``loss_start`` / ``loss_length`` in code points
    (0-based; null for the example without a target)."""
    turns = conversations.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    # Rendered once per turn; an example is a join of the first pieces.
    pieces = whole.select(
        "conv_id", "turns", F.transform("turns", _render).alias("pieces"), F.size("turns").alias("n")
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.col("n")),
        lambda k: (F.element_at("turns", k)["role"] == ASSISTANT) | (k == F.col("n")),
    )
    rows = pieces.select("*", F.explode(ends).alias("example"))
    target = F.element_at("turns", F.col("example"))
    formatted = F.array_join(F.slice("pieces", 1, F.col("example")), "")
    length = F.length(escape(target["text"]))
    return (
        rows.select(
            "conv_id", "example", (F.col("example") == F.col("n")).alias("is_last"),
            formatted.alias("formatted"),
            F.when(target["role"] == ASSISTANT, length).alias("loss_length"),
        )
        .withColumn("loss_start", F.length("formatted") - len(END) - F.col("loss_length"))
    )


def trained_text(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask as it was before formatting; null without a target."""
    return unescape(F.substring(formatted, start + 1, length))


def parse(formatted: Column) -> Column:
    """The turns of an example as ``array<struct<role, text>>``."""
    marked = F.slice(F.split(formatted, END, -1), 1, F.size(F.split(formatted, END, -1)) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(BEGIN + ROLE) + 1, F.length(piece))
        cut = F.locate(ROLE_END, body)
        return F.struct(
            unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(body, cut + len(ROLE_END), F.length(body))).alias("text"),
        )

    return F.transform(marked, turn)


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples: number and hash of its turns, and what is trained on.

    The long texts are reduced to hashes and replies before the only shuffle.
    """
    turns = parse(F.col("formatted"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    slim = examples.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.struct(
            F.size(turns).cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, ""), 256).alias("sha"),
        )).alias("all_turns"),
        trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("reply"),
    )
    grouped = slim.groupBy("conv_id").agg(
        F.max("all_turns").alias("all_turns"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.when(
                F.col("reply").isNotNull(), F.struct("example", "reply")
            ))), lambda x: x["reply"],
        ), "").alias("replies"),
        F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select(
        "conv_id", F.col("all_turns.n_turns").alias("n_turns"),
        F.col("all_turns.sha").alias("turns_sha256"),
        F.length("replies").cast("long").alias("loss_chars"),
        F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars",
    )
