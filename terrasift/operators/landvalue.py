"""The relative land value: access components, weighted score, index and share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COMPONENTS, normalised_weights
from ..storage import keep
from . import stats


def decay(distance: Column, scale: float) -> Column:
    return F.exp(-distance / scale)


def score_of(weights: dict[str, float], prefix: str = "norm_") -> Column:
    """The weighted mean of the components; a sum of weights of 0 counts as 1."""
    total = sum(weights.values()) or 1.0
    out: Column = F.lit(0.0)
    for c, w in weights.items():
        out = out + F.col(f"{prefix}{c}") * w
    return out / total


def contributions(weights: dict[str, float], prefix: str = "norm_") -> Column:
    """Each component's part of the score, in hundredths of the full score."""
    total = sum(weights.values()) or 1.0
    return F.array(*(F.struct(F.lit(c).alias("component"), (F.col(f"{prefix}{c}") * w / total * 100).alias("points")) for c, w in weights.items()))


def land_value(cells: DataFrame, scales: dict[str, float], weights: dict[str, float], by: list[str], area: str = "area_sqm") -> DataFrame:
    """cells with access, norm_<component>, land_value_score, land_value_index and
    relative_value_share. A missing road distance counts as the group's largest; a
    group without any has no road access at all."""
    weights = normalised_weights(weights)
    # Distances' extremes give those of the access that falls with them, so one aggregate serves both.
    span = {f"g_{f}_{c}": getattr(F, f)(c) for c in ("dist_cbd_km", "dist_major_road_km") for f in ("min", "max")}
    df = stats.with_group(keep(cells), by, **span)
    road = F.coalesce("dist_major_road_km", "g_max_dist_major_road_km")
    for out, d, c, scale in (("access_cbd", F.col("dist_cbd_km"), "dist_cbd_km", scales["cbd"]), ("access_major_road", road, "dist_major_road_km", scales["major_road"])):
        low, high = decay(F.col(f"g_max_{c}"), scale), decay(F.col(f"g_min_{c}"), scale)
        df = df.withColumn(out, F.coalesce(decay(d, scale), F.lit(0.0)))
        df = df.withColumn(f"norm_{out}", F.coalesce(F.when(high - low < 1e-12, 0.0).otherwise((F.col(out) - low) / (high - low)), F.lit(0.0)))
    ranks = {"norm_establishment_access": ("establishment_access", False), "norm_poi_density": ("poi_weighted_density", True), "norm_road_density": ("road_density_km", True)}
    df = stats.percent_ranks(df.drop(*span), ranks, by)
    df = keep(df.withColumn("land_value_score", score_of({c: weights[c] for c in COMPONENTS})))
    mass = F.greatest(F.col("land_value_score"), F.lit(0.0)) * F.greatest(F.col(area), F.lit(1.0))
    df = stats.with_group(df, by, g_low=F.min("land_value_score"), g_high=F.max("land_value_score"), g_mass=F.sum(mass), g_n=F.count("*"))
    index = F.when(F.col("g_high") - F.col("g_low") < 1e-12, 0.0).otherwise((F.col("land_value_score") - F.col("g_low")) / (F.col("g_high") - F.col("g_low")))
    share = F.when(F.col("g_mass") > 0, mass / F.col("g_mass")).otherwise(F.lit(1.0) / F.col("g_n"))
    return df.withColumn("land_value_index", F.round(index * 100, 2)).withColumn("relative_value_share", share).drop("g_low", "g_high", "g_mass", "g_n")


def builtup(cells: DataFrame, weights: dict[str, float], by: list[str]) -> DataFrame:
    df = stats.percent_ranks(cells, {"_p": ("poi_weighted_density", True), "_r": ("road_density_km", True)}, by)
    return df.withColumn("builtup_score", F.col("_p") * weights["poi_density"] + F.col("_r") * weights["road_density"]).drop("_p", "_r")


def colour_bounds(value: Column, log: bool = False) -> list[Column]:
    """Aggregates low and high of a colour scale; a log scale starts no lower than a
    thousandth of the top."""
    high = F.max(value)
    low = F.greatest(F.min(F.when(value > 0, value)), high / 1000) if log else F.min(value)
    return [low.alias("low"), high.alias("high")]


def legend_stops(low: Column, high: Column, n: int = 41, log: bool = False) -> Column:
    """n values from low to high, evenly or by equal ratios."""
    at = lambda i: i / F.lit(float(n - 1))
    put = (lambda i: low * F.pow(high / low, at(i))) if log else (lambda i: low + (high - low) * at(i))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), put)
