"""Schemas, deduplication, matching and set operations on tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def conform(df: DataFrame, schema: T.StructType, aliases: dict[str, str] | None = None, required: set[str] | None = None) -> DataFrame:
    """df in the columns and types of schema.

    Headers are matched in lower case and through aliases; several headers of one
    column are coalesced in their order. Optional columns that are missing are
    null, missing required ones raise ValueError. Values that do not convert are
    null, NaN is null."""
    aliases = aliases or {}
    found: dict[str, list[str]] = {}
    for c in df.columns:
        found.setdefault(aliases.get(c.lower(), c.lower()), []).append(c)
    missing = sorted((required or set()) - set(found))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    types = dict(df.dtypes)

    def cast(source: str, kind: T.DataType) -> Column:
        c = F.col(f"`{source}`")
        if isinstance(kind, T.DoubleType):
            return text.finite(text.number(c) if types[source] == "string" else c)
        if isinstance(kind, T.TimestampType):
            return text.timestamp(c) if types[source] == "string" else c.cast("timestamp")
        return c.try_cast(kind)

    return df.select(*(F.coalesce(*(cast(s, f.dataType) for s in found[f.name])).alias(f.name) if f.name in found else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def settled(df: DataFrame) -> DataFrame:
    """df whose columns are computed once, however often later expressions name them:
    the optimiser does not copy expressions past a generated row."""
    row = f"r_{uuid.uuid4().hex}"
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias(row)).select(f"{row}.*")


def pick(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, by one window over rows of a key."""
    n = f"n_{uuid.uuid4().hex}"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def latest(df: DataFrame, keys: list[str], period: str, *tie: str) -> DataFrame:
    """The row of each key with the latest period; nulls come last, then tie decides."""
    return pick(df, keys, F.col(period).desc_nulls_last(), *(F.col(t) for t in tie))


def first_of(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return pick(df, keys, F.col(seq))


def last_of(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return pick(df, keys, F.col(seq).desc())


def best_match(left: DataFrame, reference: DataFrame, key: str, place: str, id_col: str, province: str = "province", scope: str = "deposit_scope", period: str = "period", tie: str = "ref_id") -> DataFrame:
    """left joined with its best row of reference on key, or nulls.

    If a province of the candidates is named in the place, only those candidates
    count; then metro before city before others, then the latest period.

    Of a key's candidates of one province only the first in that order can win, and equal
    places have one answer, so pairs are made of distinct places and provinces."""
    rank = F.when(F.col(scope) == "metro", 0).when(F.col(scope) == "city", 1).otherwise(2)
    order = (rank, F.col(period).desc_nulls_last(), F.col(tie))
    few = pick(reference.withColumn("_own", F.lower(F.col(province))), [key, "_own"], *order)
    asked = left.select(F.col(key).alias("_key"), F.col(place).alias("_place")).distinct()
    met = asked.join(few, F.col("_key") == F.col(key)).withColumn("_named", F.coalesce((F.col("_own") != "") & F.contains(F.lower("_place"), F.col("_own")), F.lit(False)))
    best = pick(met, ["_key", "_place"], F.col("_named").desc(), *order).drop(key, "_own")
    joined = left.join(best, (F.col(key) == F.col("_key")) & F.col(place).eqNullSafe(F.col("_place")), "left")
    joined = pick(joined, [id_col], F.coalesce("_named", F.lit(False)).desc(), *order)
    return joined.select(key, *(c for c in left.columns if c != key), *(c for c in reference.columns if c != key))


def outcome_join(labels: DataFrame, cells: DataFrame, key: str, known: DataFrame, city: str, in_metro: str = "in_metro") -> DataFrame:
    """labels with their cell's columns and an outcome: missing_cache (no cells of the
    city), outside_grid, outside_metro or matched. known: the cities that have cells."""
    have = known.select(F.col(city), F.lit(True).alias("_city")).distinct()
    found = labels.join(cells.withColumn("_cell", F.lit(True)), [city, key], "left").join(have, city, "left")
    outcome = F.when(F.col("_city").isNull(), "missing_cache").when(F.col("_cell").isNull(), "outside_grid").when(~F.coalesce(F.col(in_metro), F.lit(False)), "outside_metro").otherwise("matched")
    return found.withColumn("outcome", outcome).drop("_city", "_cell")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """first, and the rows of second whose key it does not have."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def join_unique(left: DataFrame, right: DataFrame, key: str, *order: Column) -> DataFrame:
    """A left join that cannot multiply rows: of several right rows of a key the first in order counts."""
    return left.join(pick(right, [key], *order), key, "left")


#: The most rows of a side that is broadcast.
MOST_BROADCAST = 100_000
#: Rows of a block of the asking side, where both sides are larger.
ASKED = 10_000


def nearest(left: DataFrame, right: DataFrame, left_id: str, distance: Column, k: int, *tie: Column) -> DataFrame:
    """Every left row with its k nearest rows of right, and their rank and distance.

    The left rows are the queries: each is compared with all rows of right. The smaller
    side is broadcast if it has at most MOST_BROADCAST rows; beyond that queries meet
    the other side in blocks of about ASKED. Each task keeps the k best of its pairs, so
    that no more are shuffled."""
    n, m = left.count(), right.count()
    if min(n, m) <= MOST_BROADCAST:
        pairs = left.crossJoin(F.broadcast(right)) if m <= n else right.crossJoin(F.broadcast(left))
    else:
        blocks = -(-n // ASKED)
        dealt = left.withColumn("_block", F.pmod(F.xxhash64(left_id), F.lit(blocks)).cast("int"))
        pairs = dealt.join(right.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "_block").drop("_block")
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy("distance", *tie))
    pairs = pairs.select(*left.columns, *right.columns).withColumn("distance", distance)
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


#: Parts of a group that pick their own rows before the group does.
SALTS = 64


def _drawn(keys: tuple[str, ...]) -> list[Column]:
    return [F.md5(F.concat_ws("|", *keys)), *(F.col(k) for k in keys)]


def sample_top(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows that a hash of their keys picks: the same ones each time."""
    return df.orderBy(*_drawn(keys)).limit(n)


def sample_per(df: DataFrame, n: int, by: list[str], *keys: str) -> DataFrame:
    """Of each group n rows that a hash of their keys picks: the same ones each time. SALTS
    parts of a group choose n each, and the group of those, so no task sorts a whole group."""
    salt = f"s_{uuid.uuid4().hex}"
    rank = lambda parts: F.row_number().over(Window.partitionBy(*parts).orderBy(*_drawn(keys)))
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    few = salted.withColumn("_rank", rank([*by, salt])).where(F.col("_rank") <= n)
    return few.withColumn("_rank", rank(by)).where(F.col("_rank") <= n).drop("_rank", salt)
