"""Sharding by a permutation-filled lookup table (native).

Each shard has its own order of preference over the slots of a table whose size
is prime; the shards take turns, each claiming its first free slot, until the
table is full. Shards so get slots evenly, and adding or removing one moves few
slots. The table has a fixed size, so it is broadcast, and a row is placed by
one hash and one lookup.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
#: Prime, and over 100 times the number of shards: their shares differ by under 1 %.
TABLE_SIZE = 2053
#: The most slots a table may have; it is broadcast.
MOST_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The shard's index for each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, and their names differ")
    if not len(shards) <= size <= MOST_SLOTS or any(size % p == 0 for p in range(2, int(size**0.5) + 1)) or size < 2:
        raise ValueError(f"size must be a prime between the number of shards and {MOST_SLOTS}")
    at = [_number(f"{s}:offset") % size for s in shards]
    step = [_number(f"{s}:skip") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        j = turn % len(shards)
        while owner[at[j]] >= 0:
            at[j] = (at[j] + step[j]) % size
        owner[at[j]] = j
    return owner


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) for every slot, unpacked from one binary literal."""
    packed = bytearray(b"".join(i.to_bytes(4, "big") for i in fill(shards, size)))
    four = F.substring(F.lit(packed), F.col("id").cast("int") * 4 + 1, F.lit(4))
    names = F.array(*(F.lit(s) for s in shards))
    return spark.range(size).select(
        F.col("id").cast("int").alias("slot"),
        F.element_at(names, F.conv(F.hex(four), 16, 10).cast("int") + 1).alias("shard"),
    )


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """The key's slot; null counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """df with the columns slot and shard (replaced if it has them, the key itself if it
    has one of these names).

    Every row is placed by its key alone: repeated rows and ties go to the same
    shard, a null key goes where the empty string goes, an empty table stays
    empty, and the length of other columns does not matter.
    """
    table = lookup(df.sparkSession, shards, size)
    at = f"slot_{uuid.uuid4().hex}"  # no other column has this name
    placed = df.withColumn(at, slot(F.col(f"`{key}`"), size)).drop("slot", "shard")
    return placed.withColumnRenamed(at, "slot").join(F.broadcast(table), "slot")
