"""Queries on access, ranks, scores and their presentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import COMPONENTS, DEFAULTS, normalised_weights
from ..functions import geo
from ..operators import features, landvalue, stats
from .bindings import LATTICE, SCALES, haversine_sql, min_max_sql, placed, placed_sql, rank_sql, table

QUERIES, ORACLES = {}, {}
WEIGHTS = normalised_weights(DEFAULTS["landvalue"]["weights"])
_CUT = SCALES["establishment"] * features.CUTOFF
_D = "sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y))"
_CUSTOMERS, _SUPPLIERS = placed_sql("customer", "c_custkey"), placed_sql("supplier", "s_suppkey")


def customers(spark, d):
    return placed(table(spark, d, "customer"), "c_custkey", None)


def suppliers(spark, d):
    return placed(table(spark, d, "supplier"), "s_suppkey", None).withColumn("weight", (F.col("s_nationkey") % 5 + 1) / F.lit(5.0))


def gravity_access(spark, d):
    found = features.gravity(customers(spark, d), suppliers(spark, d), SCALES["establishment"], ["c_custkey"])
    return found.select("c_custkey", F.round("establishment_access", 6).alias("establishment_access"))


QUERIES["gravity_access"] = gravity_access
_GRAVITY = f"""SELECT c.c_custkey, sum(((s.s_nationkey % 5 + 1) / 5::DOUBLE) * exp(-{_D} / {SCALES['establishment']}::DOUBLE)) AS establishment_access
FROM {_CUSTOMERS} c JOIN {_SUPPLIERS} s ON {_D} <= {_CUT}::DOUBLE GROUP BY c.c_custkey"""
ORACLES["gravity_access"] = f"SELECT c_custkey, round(establishment_access, 6) AS establishment_access FROM ({_GRAVITY})"


def haversine_nearest_supplier(spark, d):
    near = features.nearest_point(
        customers(spark, d).select("c_custkey", "city", "x", "y", "lat", "lng"),
        suppliers(spark, d).select("s_suppkey", "city", F.col("x").alias("px"), F.col("y").alias("py"), F.col("lat").alias("plat"), F.col("lng").alias("plng")),
        "c_custkey", "s_suppkey", 2.0, geo.haversine_km(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng")),
        stretch=2.0,  # up to 60 degrees of latitude
    )
    return near.select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance_km"))


QUERIES["haversine_nearest_supplier"] = haversine_nearest_supplier
ORACLES["haversine_nearest_supplier"] = f"""
WITH pairs AS (SELECT c.c_custkey, s.s_suppkey, {haversine_sql('c.lat', 'c.lng', 's.lat', 's.lng')} AS km FROM {_CUSTOMERS} c CROSS JOIN {_SUPPLIERS} s),
best AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS n FROM pairs)
SELECT c_custkey, s_suppkey, round(km, 6) AS distance_km FROM best WHERE n = 1"""


def scored(spark, d):
    """Customers as cells of their nation: distances, gravity, balances as weighted
    establishments and numbers of orders as kilometres of road."""
    own = customers(spark, d).withColumn("nation", F.col("c_nationkey"))
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("road_density_km"))
    pull = features.gravity(own, suppliers(spark, d), SCALES["establishment"], ["c_custkey"])
    near = features.nearest_point(own.select("c_custkey", "city", "x", "y"), suppliers(spark, d).select("s_suppkey", "city", F.col("x").alias("px"), F.col("y").alias("py")), "c_custkey", "s_suppkey", 2.0, geo.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")))
    df = own.join(pull, "c_custkey", "left").join(near.select("c_custkey", F.col("distance").alias("dist_major_road_km")), "c_custkey", "left").join(orders, "c_custkey", "left")
    df = df.withColumns({
        "dist_cbd_km": geo.haversine_km(F.col("lat"), F.col("lng"), F.lit(10.3), F.lit(123.9)),
        "establishment_access": F.coalesce("establishment_access", F.lit(0.0)),
        "road_density_km": F.coalesce("road_density_km", F.lit(0.0)),
        "poi_weighted_density": F.greatest("c_acctbal", F.lit(0.0)),
        "area_sqm": F.lit(LATTICE.cell_area * 1e6),
    })
    return landvalue.land_value(df, SCALES, WEIGHTS, ["nation"])


_W = {c: f"{w!r}::DOUBLE" for c, w in WEIGHTS.items()}
_SCORED = f"""
WITH pull AS ({_GRAVITY}),
near AS (SELECT c.c_custkey, min({_D}) AS road FROM {_CUSTOMERS} c CROSS JOIN {_SUPPLIERS} s GROUP BY 1),
road AS (SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
base AS (
  SELECT c.*, c.c_nationkey AS nation, exp(-({haversine_sql('c.lat', 'c.lng', '10.3::DOUBLE', '123.9::DOUBLE')}) / 3.0::DOUBLE) AS ac, exp(-near.road / 0.6::DOUBLE) AS ar,
    coalesce(pull.establishment_access, 0.0::DOUBLE) AS ea, greatest(c.c_acctbal, 0.0::DOUBLE) AS poi, coalesce(road.n, 0.0::DOUBLE) AS km
  FROM {_CUSTOMERS} c LEFT JOIN pull USING (c_custkey) LEFT JOIN near USING (c_custkey) LEFT JOIN road ON o_custkey = c.c_custkey),
normed AS (
  SELECT *, {min_max_sql('ac', 'nation')} AS access_cbd, {min_max_sql('ar', 'nation')} AS access_major_road, {rank_sql('ea', 'nation')} AS establishment_access,
    {rank_sql('poi', 'nation', True)} AS poi_density, {rank_sql('km', 'nation', True)} AS road_density FROM base),
scores AS (SELECT *, {' + '.join(f'{c} * {_W[c]}' for c in COMPONENTS)} AS score FROM normed),
scored AS (SELECT *, round(({min_max_sql('score', 'nation')}) * 100, 2) AS idx, {min_max_sql('score', 'nation')} AS raw,
    greatest(score, 0) / sum(greatest(score, 0)) OVER (PARTITION BY nation) AS share FROM scores)
"""


def accessibility_index(spark, d):
    found = scored(spark, d)
    return found.select("c_custkey", "nation", F.round("land_value_score", 5).alias("score"), F.round("land_value_index", 1).alias("land_value_index"), F.round("relative_value_share", 7).alias("value_share"))


QUERIES["accessibility_index"] = accessibility_index
ORACLES["accessibility_index"] = _SCORED + "SELECT c_custkey, nation, round(score, 5) AS score, round(idx, 1) AS land_value_index, round(share, 7) AS value_share FROM scored"


def topk_cells(spark, d):
    """The twelve best cells by index; the limit is the feature."""
    found = scored(spark, d).where("land_value_score is not null")
    return found.orderBy(F.desc("land_value_score"), "c_custkey").limit(12).select("c_custkey", "nation", F.round("land_value_score", 5).alias("score"))


QUERIES["topk_cells"] = topk_cells
ORACLES["topk_cells"] = _SCORED + "SELECT c_custkey, nation, round(score, 5) AS score FROM scored WHERE score IS NOT NULL ORDER BY scored.score DESC, c_custkey LIMIT 12"

_OTHER = dict(zip(COMPONENTS, (1.0, 3.0, 0.0, 2.0, 4.0), strict=True))


def weights_recompute(spark, d):
    """The score under other weights, from the stored components."""
    df = scored(spark, d).withColumn("again", landvalue.score_of(_OTHER))
    df = stats.min_max(df, "again", "lv", ["nation"], 100.0)
    return df.select("c_custkey", F.round("again", 5).alias("score"), F.round("lv", 3).alias("index"))


QUERIES["weights_recompute"] = weights_recompute
_AGAIN = " + ".join(f"{c} * {w}::DOUBLE" for c, w in _OTHER.items())
ORACLES["weights_recompute"] = _SCORED + f", again AS (SELECT *, ({_AGAIN}) / 10::DOUBLE AS z FROM scored) SELECT c_custkey, round(z, 5) AS score, round(({min_max_sql('z', 'nation')}) * 100, 3) AS index FROM again"


def component_contributions(spark, d):
    df = scored(spark, d).select("c_custkey", F.explode(landvalue.contributions(WEIGHTS)).alias("c"))
    return df.select("c_custkey", "c.component", F.round("c.points", 4).alias("points"))


QUERIES["component_contributions"] = component_contributions
ORACLES["component_contributions"] = _SCORED + " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS component, round({c} * {w} * 100, 4) AS points FROM scored" for c, w in _W.items())


def percent_rank_avg_ties(spark, d):
    df = stats.percent_rank(table(spark, d, "part"), "p_size", "pct", ["p_brand"])
    return df.select("p_partkey", "p_brand", F.round("pct", 9).alias("pct"))


QUERIES["percent_rank_avg_ties"] = percent_rank_avg_ties
ORACLES["percent_rank_avg_ties"] = f"SELECT p_partkey, p_brand, round({rank_sql('p_size', 'p_brand')}, 9) AS pct FROM part"


def positive_rank(spark, d):
    df = stats.positive_rank(table(spark, d, "customer"), "c_acctbal", "pct", ["c_mktsegment"])
    return df.select("c_custkey", "c_mktsegment", F.round("pct", 9).alias("pct"))


QUERIES["positive_rank"] = positive_rank
ORACLES["positive_rank"] = f"SELECT c_custkey, c_mktsegment, round({rank_sql('c_acctbal', 'c_mktsegment', True)}, 9) AS pct FROM customer"


def minmax_by_group(spark, d):
    df = stats.min_max(table(spark, d, "part"), "p_retailprice", "scaled", ["p_brand"])
    return df.select("p_partkey", F.round("scaled", 9).alias("scaled"))


QUERIES["minmax_by_group"] = minmax_by_group
ORACLES["minmax_by_group"] = f"SELECT p_partkey, round({min_max_sql('p_retailprice', 'p_brand')}, 9) AS scaled FROM part"


def value_share(spark, d):
    df = stats.share(table(spark, d, "customer").withColumn("area", F.lit(1.0)), "c_acctbal", "area", "share", ["c_nationkey"])
    return df.select("c_custkey", F.round("share", 9).alias("share"))


QUERIES["value_share"] = value_share
ORACLES["value_share"] = """SELECT c_custkey, round(CASE WHEN sum(greatest(c_acctbal, 0)) OVER w > 0 THEN greatest(c_acctbal, 0) / sum(greatest(c_acctbal, 0)) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END, 9) AS share
FROM customer WINDOW w AS (PARTITION BY c_nationkey)"""


def fill_with_max(spark, d):
    """Orders under 1,000 count as missing and take their status's largest price."""
    df = table(spark, d, "orders").withColumn("price", F.when(F.col("o_totalprice") >= 1000, F.col("o_totalprice")))
    return stats.fill_with_max(df, "price", ["o_orderstatus"]).select("o_orderkey", "price")


QUERIES["fill_with_max"] = fill_with_max
ORACLES["fill_with_max"] = "SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN o_totalprice ELSE max(CASE WHEN o_totalprice >= 1000 THEN o_totalprice END) OVER (PARTITION BY o_orderstatus) END AS price FROM orders"


def colour_bounds(spark, d):
    a = table(spark, d, "customer").agg(*landvalue.colour_bounds(F.col("c_acctbal"))).select(F.lit("linear").alias("scale"), "low", "high")
    b = table(spark, d, "customer").agg(*landvalue.colour_bounds(F.col("c_acctbal"), True)).select(F.lit("log").alias("scale"), "low", "high")
    both = a.unionByName(b).withColumn("stops", landvalue.legend_stops(F.col("low"), F.col("high"), 5))
    return both.select("scale", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(F.element_at("stops", 3), 4).alias("middle"))


QUERIES["colour_bounds"] = colour_bounds
ORACLES["colour_bounds"] = """SELECT scale, round(low, 6) AS low, round(high, 6) AS high, round(low + (high - low) * 0.5::DOUBLE, 4) AS middle FROM (
SELECT 'linear' AS scale, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer
UNION ALL SELECT 'log', greatest(min(c_acctbal) FILTER (c_acctbal > 0), max(c_acctbal) / 1000), max(c_acctbal) FROM customer)"""
