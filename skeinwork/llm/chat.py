"""Chat formatting with Spark expressions only.

The turns of a conversation are collected and sorted by (turn, role, text); adjacent
turns of one role become one block, and the blocks are concatenated:

    <turn:ROLE>text<and/>text</turn><turn:ROLE>...

In roles and texts a backslash becomes \\s and the < of a control string becomes \\l
(and the > of a role \\g), so that none occurs inside a text and reading back is exact.
The loss mask covers each assistant text: spans of (start, length) in code points of
the formatted text, in order.

Defined results: null text and null role are empty; rows whose conversation is null
form one conversation; null turns come first; repeated rows are turns of their own;
extra columns are ignored. A conversation is one output row, so its turns meet in one
task, as the format demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common

# The control strings.
OPEN, CLOSE, NEXT = "<turn:", "</turn>", "<and/>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for control in (OPEN, CLOSE, NEXT):
        out = F.replace(out, F.lit(control), F.lit("\\l" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _merged(turns: Column) -> Column:
    """Blocks (role, texts, head) of adjacent turns of one role; head is where a block's texts begin in the formatted text."""
    size = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(turns, i).role != F.get(turns, i - 1).role))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(size))
    blocks = F.zip_with(starts, ends, lambda a, b: F.struct(F.get(turns, a).role.alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t.text).alias("texts")))
    return F.when(size == 0, F.array().cast("array<struct<role:string,texts:array<string>>>")).otherwise(blocks)


def _block(b: Column) -> Column:
    return F.concat(F.lit(OPEN), b.role, F.lit(">"), F.array_join(b.texts, NEXT), F.lit(CLOSE))


def _spans(blocks: Column) -> Column:
    """Where each trained text stands: sums of the lengths before each block, and before each text of a block."""
    empty = F.array().cast("array<struct<start:int,length:int>>")

    def head(b: Column) -> Column:
        return F.length(b.role) + len(OPEN) + 1

    def size(b: Column) -> Column:
        return head(b) + F.aggregate(b.texts, F.lit(0), lambda n, t: n + F.length(t)) + (F.size(b.texts) - 1) * len(NEXT) + len(CLOSE)

    def texts(b: Column, start: Column) -> Column:
        places = common.before(F.transform(b.texts, lambda t: F.length(t) + len(NEXT)))
        return F.zip_with(places, b.texts, lambda x, t: F.struct((start + head(b) + x).alias("start"), F.length(t).alias("length")))

    starts = common.before(F.transform(blocks, size))
    return F.flatten(F.zip_with(blocks, starts, lambda b, start: F.when(b.role == TRAINED, texts(b, start)).otherwise(empty)))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation."""
    rows = common.only(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit(">"), F.lit("\\g"))
    turn = F.struct("turn", role.alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    blocks = chats.select("conv_id", _merged(F.col("turns")).alias("blocks"))
    return blocks.select("conv_id", F.array_join(F.transform("blocks", _block), "").alias("formatted"), _spans(F.col("blocks")).alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were."""

    def of_block(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), ">", 1)
        texts = F.split(F.substr(b, F.length(role) + len(OPEN) + 2), NEXT, -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, CLOSE, -1), lambda b: b != ""), of_block))


def trained_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s.start + 1, s.length))), "")
