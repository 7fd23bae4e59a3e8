"""Chat formatting after a collapse of cumulative snapshots.

A conversation that was logged after each turn appears several times, each a
prefix of the next. Every prefix of a conversation gets a rolling hash: the
running exclusive-or of two 64-bit hashes of (position, role, text). One whose
whole hash and length are those of a shorter prefix of another, or of an equal
conversation with a smaller conv_id, is a snapshot and goes by anti-join; the
maximal ones are rendered.

Defined results: rows with a null conv_id are left out. Turns go in the order of
(turn, role, text), nulls first; a row that is repeated whole counts once. A null
role reads "unknown", a null text as an empty one (for the hash they differ from
both). In texts and roles "<|" becomes "< |", so that none can forge a marker.
Texts of any length are rendered whole. No rows give no rows. Columns other than
conv_id, turn, role and text aren't looked at; a conv_id and a turn must be numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TURN_OPEN, TURN_MID, TURN_CLOSE = "<|", "|>\n", "<|end|>\n"


def _own(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    ).where("conv_id is not null")


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, length, one, two, last) of each prefix of each conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    row = F.struct("turn", "role", "text")
    once = _own(conversations).withColumn("_before", F.lag(row).over(order)).where(~row.eqNullSafe(F.col("_before")))
    placed = once.withColumn("length", F.row_number().over(order))

    def turn_hash(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), "length", F.col("role").isNull(), "role", F.col("text").isNull(), "text")

    hashed = placed.select("conv_id", "turn", "role", "text", "length", turn_hash(1).alias("_1"), turn_hash(2).alias("_2"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select(
        "conv_id",
        "length",
        F.bit_xor("_1").over(running).alias("one"),
        F.bit_xor("_2").over(running).alias("two"),
        F.lead("length").over(order).isNull().alias("last"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no snapshot of another."""
    prefixes = materialize(prefix_hashes(conversations))
    whole = prefixes.where("last").groupBy("length", "one", "two").agg(F.min("conv_id").alias("conv_id"))
    return whole.join(prefixes.where("not last"), ["length", "one", "two"], "left_anti").select("conv_id")


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, chat) of each maximal conversation."""
    kept = _own(conversations).join(maximal_conversations(conversations), "conv_id", "left_semi")
    turns = kept.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("turn", "role", "text")))).alias("turns"))
    rendered = F.transform(
        "turns",
        lambda t: F.concat(
            F.lit(TURN_OPEN), _plain(F.coalesce(t["role"], F.lit("unknown"))), F.lit(TURN_MID), _plain(F.coalesce(t["text"], F.lit(""))), F.lit(TURN_CLOSE)
        ),
    )
    return turns.select("conv_id", F.size("turns").alias("n_turns"), F.array_join(rendered, "").alias("chat"))
