"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted (turn, role, text), and
written one after the other; adjacent turns of one role share a block::

    ### user :
    first text
    <part>
    second text
    </turn>

Every backslash, ``#`` and ``<`` of a text gets a backslash before it, and so
does ``:`` in a role. The markers start with a line feed and ``<``, which an
escaped text never holds, so formatting is reversible for any text.

Nulls and edge cases: a null text or role is empty. Rows with a null
``conv_id`` are one conversation. Repeated turns stay, in order of role and
text. A conversation is one output string, so one conversation must fit a row.
Extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, PART, END = "### ", " :\n", "\n<part>\n", "\n</turn>\n"


def escape(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{also}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): ``loss_spans`` are start and length, in
    characters of ``formatted``, of every text of ``trained_role``."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def write(t: Column, i: Column) -> Column:
        follows = (i > 0) & (F.get(F.col("ts"), i - 1)["role"] == t["role"])
        goes_on = (i < F.size("ts") - 1) & (F.get(F.col("ts"), i + 1)["role"] == t["role"])
        return F.struct(
            F.when(follows, F.lit("")).otherwise(F.concat(F.lit(HEAD), escape(t["role"], ":"), F.lit(COLON))).alias("before"),
            escape(t["text"]).alias("text"), F.when(goes_on, F.lit(PART)).otherwise(F.lit(END)).alias("after"),
            (t["role"] == trained_role).alias("loss"))

    written = sorted_turns.select("conv_id", F.transform("ts", write).alias("ws"))
    whole = F.array_join(F.transform("ws", lambda w: F.concat(w["before"], w["text"], w["after"])), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(s: Column, w: Column) -> Column:
        begin, n = s["at"] + F.length(w["before"]), F.length(w["text"])
        span = F.array(F.struct(begin.alias("start"), n.alias("length")))
        return F.struct((begin + n + F.length(w["after"])).alias("at"),
                        F.when(w["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate("ws", start, step, lambda s: s["spans"])
    return written.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The input with ``turns`` (role, text) read from ``formatted``, and
    ``loss_texts``, the unescaped texts under the mask."""

    def block(b: Column) -> Column:
        cut = F.instr(b, COLON)
        role = unescape(F.substring(b, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1))
        parts = F.split(F.substring(b, cut + len(COLON), F.length(b)), PART, -1)
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, block)), "loss_texts": under})
