"""Chat formatting with Spark expressions only.

Template: a block per run of equal roles. An assistant block is ``<s>role\\n ... \\n</s>``, any other
``[INST]role\\n ... \\n[/INST]``; the turns of a block are joined by ``\\n[SEP]\\n``. A control string inside a
text gets one more backslash in front, roles escape backslash and line feed, so reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.runtime import tune

# The control strings of the template.
OPEN, CLOSE = "[INST]", "[/INST]"
OPEN_LOSS, CLOSE_LOSS = "<s>", "</s>"
SEPARATOR = "\n[SEP]\n"
CONTROL = r"(?:</?s>|\[/?INST\]|\[SEP\])"
BLOCK_END = r"\n(?:\[/INST\]|</s>)"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\*{CONTROL}", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """conv_id, formatted, one row per conversation (null is one conversation of its own).

    Turns are ordered by turn, then role, then text; null turns come first, null roles and texts are empty.
    Repeated rows stay repeated turns. Other columns are ignored. One conversation is one string, so its rows meet in
    one task; texts are escaped before they are collected.
    """
    tune(turns.sparkSession)
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 escape(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1),
                      lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    marked = grouped.withColumn("starts", starts)

    def block(start: Column, number: Column) -> Column:
        after = F.coalesce(F.get("starts", number + 1), F.size("turns"))
        name = F.get("turns", start)["role"]
        texts = F.transform(F.slice("turns", start + 1, after - start), lambda t: t["text"])
        loss = name == ASSISTANT
        return F.concat(F.when(loss, OPEN_LOSS).otherwise(OPEN), _escape_role(name), F.lit("\n"),
                        F.array_join(texts, SEPARATOR), F.lit("\n"), F.when(loss, CLOSE_LOSS).otherwise(CLOSE))

    return marked.select("conv_id", F.array_join(F.transform("starts", block), "").alias("formatted"))


def read_back(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """The frame with ``blocks``: array of (role, loss, texts) read from the formatted strings, unescaped."""
    pieces = F.split(F.col(column), BLOCK_END, -1)
    bodies = F.slice(pieces, 1, F.size(pieces) - 1)

    def parsed(body: Column) -> Column:
        loss = body.startswith(OPEN_LOSS)
        inner = F.substr(body, F.when(loss, len(OPEN_LOSS) + 1).otherwise(len(OPEN) + 1))
        cut = F.instr(inner, "\n")
        texts = F.split(F.substr(inner, cut + 1), r"\n\[SEP\]\n", -1)
        return F.struct(_unescape_role(F.substr(inner, F.lit(1), cut - 1)).alias("role"), loss.alias("loss"),
                        F.transform(texts, unescape).alias("texts"))

    return formatted.withColumn("blocks", F.transform(bodies, parsed))


def loss_spans(read: DataFrame) -> DataFrame:
    """conv_id and the texts under the loss mask, in order, one row per block that carries loss."""
    return read.select("conv_id", F.posexplode(F.filter("blocks", lambda b: b["loss"])).alias("block", "b")).select(
        "conv_id", "block", F.col("b.texts").alias("texts"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the strings."""
    read = read_back(formatted)
    lines = F.flatten(F.transform("blocks", lambda b: F.transform(
        b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n")))))
    loss = F.array_join(F.flatten(F.transform(F.filter("blocks", lambda b: b["loss"]), lambda b: b["texts"])), "")
    return read.select(
        "conv_id", F.size(lines).cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
