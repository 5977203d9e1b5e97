"""Ranks, scales, shares, quantiles and errors, per group.

Group figures come from partial aggregates joined back, not from windows over whole
groups, so one group with most of the rows does not land in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep

#: Value ranges that a group's ranks are worked out in.
BUCKETS = 256
#: Cuts between ranges that are looked at together.
STEP = 16


def _name() -> str:
    return f"t_{uuid.uuid4().hex}"


def with_group(df: DataFrame, by: list[str], **figures: Column) -> DataFrame:
    """df with aggregates of its groups as columns; null group keys match null."""
    keys = {b: _name() for b in by}
    totals = df.groupBy(*by).agg(*(c.alias(n) for n, c in figures.items()))
    if not by:
        return df.crossJoin(F.broadcast(totals))  # one row
    totals = totals.select(*(F.col(b).alias(k) for b, k in keys.items()), *figures)
    on = None
    for b, k in keys.items():
        c = F.col(b).eqNullSafe(F.col(k))
        on = c if on is None else on & c
    return df.join(totals, on, "left").drop(*keys.values())


def min_max(df: DataFrame, value: str, out: str, by: list[str], scale: float = 1.0) -> DataFrame:
    """value stretched to 0..scale in its group; 0 where the group's range is under 1e-12."""
    lo, hi = _name(), _name()
    df = with_group(df, by, **{lo: F.min(value), hi: F.max(value)})
    x = F.when(F.col(hi) - F.col(lo) < 1e-12, F.when(F.col(value).isNotNull(), 0.0)).otherwise((F.col(value) - F.col(lo)) / (F.col(hi) - F.col(lo)))
    return df.withColumn(out, x * scale).drop(lo, hi)


def percent_ranks(df: DataFrame, ranks: dict[str, tuple[str, bool]], by: list[str]) -> DataFrame:
    """df with a column for each {out: (value, positive)}: the average rank of value among
    its group's values over their number; null stays null. Of positive ranks only
    values above 0 take part, everything else is 0.

    All values are counted together, then dealt to BUCKETS ranges of their group that hold
    about equally many different values, however they are spread; a rank is what lies in
    lower ranges, plus the place in its own. df is read twice, however many ranks are
    asked for."""
    value = {out: F.when(F.col(v) > 0, F.col(v).cast("double")) if positive else F.col(v).cast("double") for out, (v, positive) in ranks.items()}
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(out).alias("r_out"), v.alias("r_v")) for out, v in value.items()))).alias("r"))
    keys = [*by, "r_out"]
    counted = keep(long.select(*by, "r.*").where("r_v is not null").groupBy(*keys, "r_v").agg(F.count("*").alias("r_n")))
    cuts = F.percentile_approx("r_v", [i / BUCKETS for i in range(1, BUCKETS)], 4 * BUCKETS)
    spans = with_group(counted, keys, r_total=F.sum("r_n"), r_cuts=cuts)
    # The range of a value is how many cuts are below it: of STEP cuts first the last ones, then the rest.
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col("r_v")))
    lasts = F.transform(F.sequence(F.lit(1), F.lit(BUCKETS // STEP - 1)), lambda i: F.get(F.col("r_cuts"), i * STEP - 1))
    spans = spans.withColumn("r_part", below(lasts)).withColumn("r_bucket", F.col("r_part") * STEP + below(F.slice("r_cuts", F.col("r_part") * STEP + 1, STEP))).drop("r_cuts", "r_part")
    up = Window.partitionBy(*keys).orderBy("r_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy(*keys, "r_bucket").agg(F.sum("r_n").alias("own")).withColumn("r_lower", F.coalesce(F.sum("own").over(up), F.lit(0)))
    inside = Window.partitionBy(*keys, "r_bucket").orderBy("r_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = spans.withColumn("r_before", F.coalesce(F.sum("r_n").over(inside), F.lit(0)))
    lower = sums.select(*(F.col(k).alias(f"s_{k}") for k in [*keys, "r_bucket"]), "r_lower")
    ranked = ranked.join(lower, same([*keys, "r_bucket"], "s_"))
    rank = (F.col("r_lower") + F.col("r_before") + (F.col("r_n") + 1) / F.lit(2.0)) / F.col("r_total")
    ranked = keep(ranked.select(*keys, "r_v", rank.alias("r_rank")))
    for out, (_, positive) in ranks.items():
        own = ranked.where(F.col("r_out") == out).select(*(F.col(b).alias(f"k_{b}") for b in by), F.col("r_v").alias("k_v"), F.col("r_rank").alias(f"k_{out}"))
        df = df.drop(out).join(own, (value[out] == F.col("k_v")) & same(by, "k_"), "left").withColumn(out, F.coalesce(F.col(f"k_{out}"), F.lit(0.0)) if positive else F.col(f"k_{out}"))
        df = df.drop("k_v", f"k_{out}", *(f"k_{b}" for b in by))
    return df


def same(columns: list[str], prefix: str) -> Column:
    """Equality of columns and their prefixed copies; null equals null."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def percent_rank(df: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    return percent_ranks(df, {out: (value, False)}, by)


def positive_rank(df: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    return percent_ranks(df, {out: (value, True)}, by)


def share(df: DataFrame, score: str, area: str, out: str, by: list[str]) -> DataFrame:
    """Each row's part of its group's score times area (score at least 0, area at
    least 1); equal parts where that sums to nothing."""
    mass, total, n = _name(), _name(), _name()
    df = df.withColumn(mass, F.greatest(F.col(score), F.lit(0.0)) * F.greatest(F.col(area), F.lit(1.0)))
    df = with_group(df, by, **{total: F.sum(mass), n: F.count("*")})
    return df.withColumn(out, F.when(F.col(total) > 0, F.col(mass) / F.col(total)).otherwise(F.lit(1.0) / F.col(n))).drop(mass, total, n)


def fill_with_max(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Nulls replaced by the group's largest value; a group without values stays null."""
    top = _name()
    return with_group(df, by, **{top: F.max(value)}).withColumn(value, F.coalesce(value, top)).drop(top)


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float, by: list[str], out: str = "quantile") -> DataFrame:
    """(by, out): the least value at which the weight of it and all lower ones reaches
    q of the group's. Rows whose value is not finite or weight not positive do not count.

    Equal values are added up first; a group's distinct values are summed in order,
    in one window per group, so groups should be of cells or labels, not of raw events."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (w > 0) & (w != float("inf")) & ~F.isnan(w)
    summed = df.where(ok).groupBy(*by, v.alias("v")).agg(F.sum(w).alias("w"))
    order = Window.partitionBy(*by).orderBy("v")
    summed = summed.withColumn("so_far", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(Window.partitionBy(*by)))
    q = min(max(q, 0.0), 1.0)
    # The last value stands in where rounding keeps the sum just below the target.
    hit = F.min(F.when(F.col("so_far") >= F.col("total") * q, F.col("v")))
    return summed.groupBy(*by).agg(F.coalesce(hit, F.max("v")).alias(out))


def quantile(value: str, q: float) -> Column:
    """Exact quantile with linear interpolation, as an aggregate."""
    return F.percentile(F.col(value), F.lit(q))


def weighted_mean(value: Column, weight: Column) -> Column:
    """As an aggregate: over finite values of positive weight, else the plain mean."""
    ok = value.isNotNull() & (F.abs(value) != float("inf")) & ~F.isnan(value) & (weight > 0)
    return F.coalesce(F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight))), F.avg(value))


def errors(actual: Column, predicted: Column) -> list[Column]:
    """Aggregates: mae, median_ae, median_ape and r2_log of positive prices."""
    e = F.abs(actual - predicted)
    la, lp = F.log(actual), F.log(predicted)
    return [
        F.avg(e).alias("mae"),
        F.median(e).alias("median_ae"),
        F.median(e / actual).alias("median_ape"),
        (1 - F.try_divide(F.sum((la - lp) * (la - lp)), F.nullif(F.var_pop(F.when(lp.isNotNull(), la)) * F.count(F.when(la.isNotNull(), lp)), F.lit(0.0)))).alias("r2_log"),
    ]
