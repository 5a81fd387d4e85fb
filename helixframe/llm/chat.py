"""Collapse of cumulative conversation snapshots, then chat formatting, in DataFrame operations only.

Logs often hold a conversation several times, each time with more turns. A turn's hash covers its place (turn number
less the conversation's first), role and text; the hash of a prefix is the exclusive or of its turns' hashes, two of 64
bits, so that it rolls along a conversation. A conversation whose hash at its last turn is that of a proper prefix
of another one is dropped by an anti-join; of equal ones the smallest id stays. Prefixes are made distinct first, so one
that begins a third of all conversations is one row.

Turns are dealt by ranges of (conversation, turn, role, text), so a task's rows are a stretch of that order, however
long one conversation or one turn number is. Hashes and counts roll within a stretch; what the stretches of a conversation
before it hold (one row for each conversation and stretch) is carried over. So no window and no task holds a whole long
conversation. What remains is rendered in chunks of ``block`` rows by position in the conversation, whatever the turn
numbers are; up to ``block`` rows that is one chunk per conversation.

Defined cases: a null turn is turn 0, null role ``unknown``, null text empty, and rows of null conv_id are one
conversation; repeated rows of a conversation count once; different texts of the same turn are turns in the order of
role and text; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

BEGIN, END = "<|im_start|>", "<|im_end|>"
ORDER = ("turn", "role", "text")


def stretched_turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with the stretch they lie in: conv_id, turn, role, text, stretch."""
    t = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = write_table(t.distinct(), "turns")  # ranges are drawn from a sample of it first
    return write_table(t.repartitionByRange("conv_id", *ORDER).withColumn("stretch", F.spark_partition_id()), "stretches")


def _carried(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``parts``, one row for each conversation and stretch."""
    p = parts.withColumnsRenamed({"conv_id": "_c", "stretch": "_s"})
    return rows.join(p, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("stretch") == F.col("_s"))).drop("_c", "_s")


def rolled_turns(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, n (position from 1), total and the hashes p1, p2 of the conversation up to and with the turn."""
    over = Window.partitionBy("conv_id")
    before = over.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    first = turns.groupBy("conv_id", "stretch").agg(F.min("turn").alias("low")).select("conv_id", "stretch", F.min("low").over(over).alias("first"))
    h = lambda seed: F.xxhash64(F.lit(seed), "place", "role", "text")
    placed = _carried(turns, first).withColumn("place", F.col("turn") - F.col("first"))
    hashed = write_table(placed.select("conv_id", "stretch", *ORDER, h(1).alias("h1"), h(2).alias("h2")), "turn_hashes")
    part = hashed.groupBy("conv_id", "stretch").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.count(F.lit(1)).alias("k"))
    none = lambda c: F.coalesce(c, F.lit(0))
    part = part.select("conv_id", "stretch", none(F.bit_xor("x1").over(before)).alias("b1"), none(F.bit_xor("x2").over(before)).alias("b2"), none(F.sum("k").over(before)).alias("bn"), F.sum("k").over(over).alias("total"))
    so_far = Window.partitionBy("conv_id", "stretch").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.withColumns({"p1": F.bit_xor("h1").over(so_far), "p2": F.bit_xor("h2").over(so_far), "pn": F.count(F.lit(1)).over(so_far)})
    r = _carried(inside, part)
    return r.select("conv_id", "role", "text", (F.col("pn") + F.col("bn")).alias("n"), "total", F.col("p1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("b2")).alias("p2"))


def maximal_conversations(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no proper prefix of another, one of each set of equal ones."""
    is_last = F.col("n") == F.col("total")
    finals = rolled.where(is_last).groupBy("p1", "p2", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = rolled.where(~is_last).select("p1", "p2", "n").distinct()
    return finals.join(proper, ["p1", "p2", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column, begin: str = BEGIN, end: str = END) -> Column:
    return F.concat(F.lit(begin), role, F.lit("\n"), text, F.lit(end))


def format_chats(conversations: DataFrame, block: int = 256, begin: str = BEGIN, end: str = END) -> DataFrame:
    """conv_id, chunk, n_turns (of the conversation), chunk_turns, n_copies and text, rendered, of maximal conversations."""
    rolled = write_table(rolled_turns(stretched_turns(conversations)), "rolled_turns")
    last = F.floor((F.col("n_turns") - 1) / block)
    # one row for each chunk of what stays, so that the join has no key of more than ``block`` turns
    keep = maximal_conversations(rolled).select(F.col("conv_id").alias("_k"), "n_turns", "n_copies", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_c"))
    placed = rolled.select("conv_id", F.floor((F.col("n") - 1) / block).alias("chunk"), "n", rendered(F.col("role"), F.col("text"), begin, end).alias("line"))
    stay = placed.join(keep, F.col("conv_id").eqNullSafe(F.col("_k")) & (F.col("chunk") == F.col("_c")))
    rows = stay.groupBy("conv_id", "chunk", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("t"))  # ``block`` turns at most
    return rows.select("conv_id", "chunk", "n_turns", F.size("t").cast("long").alias("chunk_turns"), "n_copies", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"))
