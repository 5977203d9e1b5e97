"""Collapse of cumulative conversation snapshots, and rendering.

A log often holds a conversation again after each turn. Every conversation gets
the rolling hash of each of its turn prefixes; one whose whole hash is a proper
prefix of another is dropped by an anti-join, and of equal conversations the one
with the smallest id stays. What is left is rendered for training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turn_digest(t: Column) -> Column:
    return F.md5(F.concat(F.md5(t["role"]), F.md5(t["text"])))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, prefixes): a row per conversation, its turns in order, and
    the rolling hash after each. Rows without conv_id belong to no conversation
    and go; null turn numbers come first, null role and text count as empty; equal
    turn numbers are ordered by role, then text; fully repeated rows count once."""
    empty = F.lit("")
    row = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    whole = turns.where(F.col("conv_id").isNotNull()).select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    rolled = F.aggregate(
        "turns",
        F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")),
        lambda acc, t: F.struct(
            F.md5(F.concat(acc["last"], _turn_digest(t))).alias("last"),
            F.concat(acc["all"], F.array(F.md5(F.concat(acc["last"], _turn_digest(t))))).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    return whole.withColumn("prefixes", rolled)


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of the conversations that no other one continues."""
    whole = conversations(turns)
    slim = whole.select("conv_id", F.element_at("prefixes", -1).alias("hash"), "prefixes")
    first = slim.groupBy("hash").agg(F.min("conv_id").alias("conv_id"))
    continued = slim.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("hash")).distinct()
    kept = first.join(continued, "hash", "left_anti").select("conv_id")
    return whole.select("conv_id", "turns").join(kept, "conv_id", "left_semi")


def render(turns: Column) -> Column:
    """One text: each turn between markers, with its role on the first line."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations of
    (conv_id, turn, role, text). An empty table gives an empty one; other columns
    are ignored; see conversations() for nulls and ties. A conversation is one row, so its turns
    together must fit into a task; there may be any number of conversations."""
    return maximal(turns).select("conv_id", F.size("turns").cast("long").alias("n_turns"), render(F.col("turns")).alias("rendered"))
