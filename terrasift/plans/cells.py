"""Queries on the lattice: counts, roads, water, downtown, connectivity."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import geo, hexgrid
from ..operators import features, graph
from ..sources import sinks
from .access import customers, suppliers
from .bindings import LATTICE, ORIGIN, SCALES, _KX, _KY, celled_sql, placed, placed_sql, rank_sql, table

QUERIES, ORACLES = {}, {}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_CUSTOMER_CELLS = celled_sql(placed_sql("customer", "c_custkey"))
_SUPPLIER_CELLS = celled_sql(placed_sql("supplier", "s_suppkey"))


def occupied(spark, d):
    """(city, cell, n, w): the cells that customers lie in."""
    own = customers(spark, d).withColumn("cell", LATTICE.cell(F.col("lat"), F.col("lng")))
    return own.groupBy("city", "cell").agg(F.count("*").alias("n"), F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("w"))


_OCCUPIED = f"SELECT cell, q, r, count(*) AS n, sum(greatest(c_acctbal, 0)) AS w FROM {_CUSTOMER_CELLS} GROUP BY cell, q, r"


def poi_counts_by_cell(spark, d):
    return occupied(spark, d).select("cell", F.col("n").alias("poi_count"), F.round("w", 4).alias("poi_weighted_density"), F.round(LATTICE.lat(F.col("cell")), 9).alias("lat"), F.round(LATTICE.lng(F.col("cell")), 9).alias("lng"))


QUERIES["poi_counts_by_cell"] = poi_counts_by_cell
ORACLES["poi_counts_by_cell"] = f"""SELECT cell, n AS poi_count, round(w, 4) AS poi_weighted_density,
round((({LATTICE.edge}::DOUBLE * (1.5::DOUBLE * r)) / {_KY}::DOUBLE) + {ORIGIN[0]}::DOUBLE, 9) AS lat,
round((({LATTICE.edge}::DOUBLE * ({math.sqrt(3)!r}::DOUBLE * q + {math.sqrt(3) / 2!r}::DOUBLE * r)) / {_KX}::DOUBLE) + {ORIGIN[1]}::DOUBLE, 9) AS lng FROM ({_OCCUPIED})"""


def poi_category_pivot(spark, d):
    """Cells of suppliers with the customers in them by segment, 0 where none lie."""
    base = suppliers(spark, d).select("city", LATTICE.cell(F.col("lat"), F.col("lng")).alias("cell")).distinct()
    pois = customers(spark, d).select("city", "lat", "lng", F.col("c_mktsegment").alias("category"), F.lit(1.0).alias("weight"))
    found = features.poi_counts(base, pois, LATTICE, SEGMENTS)
    return found.select("cell", "poi_count", *(F.col(f"poi_count_{c}").alias(f"n_{c.lower()}") for c in SEGMENTS))


QUERIES["poi_category_pivot"] = poi_category_pivot
ORACLES["poi_category_pivot"] = f"""SELECT b.cell, count(c.c_custkey)::INT AS poi_count, {', '.join(f"(count(*) FILTER (c.c_mktsegment = '{s}'))::INT AS n_{s.lower()}" for s in SEGMENTS)}
FROM (SELECT DISTINCT cell FROM {_SUPPLIER_CELLS}) b LEFT JOIN {_CUSTOMER_CELLS} c USING (cell) GROUP BY b.cell"""

_STEP = 1 << 21
_OFFSETS = {k: ", ".join(f"({q * _STEP + r})" for q, r in hexgrid.offsets(k)) for k in (1, 2, 3)}


def neighbourhood_smoothing(spark, d):
    return features.smoothed(occupied(spark, d).withColumn("v", F.col("n").cast("double")), "v", "smooth").select("cell", F.round("smooth", 9).alias("smooth"))


QUERIES["neighbourhood_smoothing"] = neighbourhood_smoothing
ORACLES["neighbourhood_smoothing"] = f"""WITH cells AS ({_OCCUPIED}), way(o) AS (VALUES {_OFFSETS[2]})
SELECT a.cell, round(avg(b.n::DOUBLE), 9) AS smooth FROM cells a CROSS JOIN way JOIN cells b ON b.cell = a.cell + way.o GROUP BY a.cell"""


def grid_disk_sizes(spark, d):
    """For each occupied cell how many occupied cells lie within 1 and 2 steps, and its
    distance from the origin's cell."""
    cells = occupied(spark, d).select("cell")
    near = cells.select("cell", F.explode(hexgrid.disk(F.col("cell"), 2)).alias("other")).join(cells.select(F.col("cell").alias("other")), "other")
    centre = hexgrid.pack(F.lit(0), F.lit(0))
    return near.groupBy("cell").agg(F.count_if(hexgrid.steps(F.col("cell"), F.col("other")) <= 1).alias("within_1"), F.count("*").alias("within_2")).withColumn("from_centre", hexgrid.steps(F.col("cell"), centre))


QUERIES["grid_disk_sizes"] = grid_disk_sizes
ORACLES["grid_disk_sizes"] = f"""WITH cells AS ({_OCCUPIED}), pairs AS (SELECT a.cell, a.q, a.r, (abs(a.q - b.q) + abs(a.r - b.r) + abs(a.q - b.q + a.r - b.r)) / 2 AS steps FROM cells a CROSS JOIN cells b)
SELECT cell, count(*) FILTER (steps <= 1) AS within_1, count(*) AS within_2, ((abs(any_value(q)) + abs(any_value(r)) + abs(any_value(q + r))) / 2)::INT AS from_centre FROM pairs WHERE steps <= 2 GROUP BY cell"""


def cbd_detect(spark, d):
    """Downtown of the customers' cells, suppliers standing for roads."""
    cells = occupied(spark, d).withColumnRenamed("w", "poi_weighted_density")
    roads = suppliers(spark, d).groupBy("city", LATTICE.cell(F.col("lat"), F.col("lng")).alias("cell")).agg(F.count("*").cast("double").alias("road_density_km"))
    cells = cells.join(roads, ["city", "cell"], "left").fillna(0.0, ["road_density_km"]).withColumn("lat", LATTICE.lat(F.col("cell"))).withColumn("lng", LATTICE.lng(F.col("cell")))
    return features.downtown(cells).select("cell", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


QUERIES["cbd_detect"] = cbd_detect


def _rank01(value: str) -> str:
    part = f"PARTITION BY ({value}) > 0"
    return f"CASE WHEN {value} > 0 THEN (rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({part}, {value}) - 1) / 2.0::DOUBLE) / count(*) OVER ({part}) ELSE 0.0::DOUBLE END"


ORACLES["cbd_detect"] = f"""WITH cells AS (SELECT a.*, coalesce(b.m, 0)::DOUBLE AS km FROM ({_OCCUPIED}) a LEFT JOIN (SELECT cell, count(*) AS m FROM {_SUPPLIER_CELLS} GROUP BY 1) b USING (cell)),
scored AS (SELECT *, 0.8::DOUBLE * ({_rank01('km')}) + 0.2::DOUBLE * ({_rank01('w')}) AS score FROM cells), way(o) AS (VALUES {_OFFSETS[2]}),
smooth AS (SELECT a.cell, any_value(a.q) AS q, any_value(a.r) AS r, avg(b.score) AS s FROM scored a CROSS JOIN way JOIN scored b ON b.cell = a.cell + way.o GROUP BY a.cell)
SELECT cell, round((({LATTICE.edge}::DOUBLE * (1.5::DOUBLE * r)) / {_KY}::DOUBLE) + {ORIGIN[0]}::DOUBLE, 6) AS lat,
round((({LATTICE.edge}::DOUBLE * ({math.sqrt(3)!r}::DOUBLE * q + {math.sqrt(3) / 2!r}::DOUBLE * r)) / {_KX}::DOUBLE) + {ORIGIN[1]}::DOUBLE, 6) AS lng FROM smooth ORDER BY round(s, 9) DESC, cell LIMIT 1"""


def road_segments(spark, d):
    """Roads from each supplier to the next key's place, up to 3 km long."""
    own = suppliers(spark, d)
    other = placed(own.select((F.col("s_suppkey") + 1).alias("k")), "k", None).select(F.col("k"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = own.select("city", F.col("s_suppkey").alias("road_id"), (F.col("s_suppkey") + 1).alias("k"), F.col("x").alias("x1"), F.col("y").alias("y1")).join(other, "k")
    # A tenth of the way keeps the roads local.
    return met.select("city", "road_id", (F.col("road_id") % 3 == 0).alias("is_major"), "x1", "y1", (F.col("x1") + (F.col("x2") - F.col("x1")) / 10).alias("x2"), (F.col("y1") + (F.col("y2") - F.col("y1")) / 10).alias("y2"))


_ROADS = f"""(SELECT a.s_suppkey AS road_id, a.x AS x1, a.y AS y1, a.x + (b.x - a.x) / 10 AS x2, a.y + (b.y - a.y) / 10 AS y2
FROM {placed_sql('supplier', 's_suppkey')} a JOIN {placed_sql('(SELECT s_suppkey + 1 AS k FROM supplier)', 'k')} b ON b.k = a.s_suppkey + 1)"""


def road_length_by_cell(spark, d):
    return features.road_length(road_segments(spark, d), LATTICE).select("cell", F.round("road_density_km", 6).alias("road_density_km"))


QUERIES["road_length_by_cell"] = road_length_by_cell


def _road_length_sql() -> str:
    """Each segment against all cells of its box, clipped by the six sides in turn."""
    e = LATTICE.edge
    corner = [(e * math.cos(math.radians(60 * k - 30)), e * math.sin(math.radians(60 * k - 30))) for k in range(6)]
    cx = f"({e}::DOUBLE * ({math.sqrt(3)!r}::DOUBLE * q + {math.sqrt(3) / 2!r}::DOUBLE * r))"
    cy = f"({e}::DOUBLE * (1.5::DOUBLE * r))"
    sql = f"""WITH seg AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, least(y1, y2) - {e} AS ly, greatest(y1, y2) + {e} AS hy, least(x1, x2) - {e} AS lx, greatest(x1, x2) + {e} AS hx FROM {_ROADS}),
rs AS (SELECT *, unnest(range(floor(ly / (1.5 * {e}))::BIGINT, ceil(hy / (1.5 * {e}))::BIGINT + 1)) AS r FROM seg),
qs AS (SELECT *, unnest(range(floor(lx / (sqrt(3) * {e}) - r / 2)::BIGINT, ceil(hx / (sqrt(3) * {e}) - r / 2)::BIGINT + 1)) AS q FROM rs),
s0 AS (SELECT *, {cx} AS cx, {cy} AS cy, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM qs)"""
    for k in range(6):
        (ax, ay), (bx, by) = corner[k], corner[(k + 1) % 6]
        at = f"(((cx + {bx!r}::DOUBLE) - (cx + {ax!r}::DOUBLE)) * (y1 - (cy + {ay!r}::DOUBLE)) - ((cy + {by!r}::DOUBLE) - (cy + {ay!r}::DOUBLE)) * (x1 - (cx + {ax!r}::DOUBLE)))"
        go = f"(((cx + {bx!r}::DOUBLE) - (cx + {ax!r}::DOUBLE)) * dy - ((cy + {by!r}::DOUBLE) - (cy + {ay!r}::DOUBLE)) * dx)"
        sql += f""", s{k + 1} AS (SELECT * EXCLUDE (lo, hi), CASE WHEN {go} > 0 THEN greatest(lo, -{at} / {go}) WHEN {go} = 0 AND {at} < 0 THEN 2.0::DOUBLE ELSE lo END AS lo,
  CASE WHEN {go} < 0 THEN least(hi, -{at} / {go}) ELSE hi END AS hi FROM s{k})"""
    return sql + """ SELECT ((q + 1048576) * 2097152 + (r + 1048576))::BIGINT AS cell, round(sum((hi - lo) * sqrt(dx * dx + dy * dy)), 6) AS road_density_km FROM s6 WHERE hi > lo AND (dx <> 0 OR dy <> 0) GROUP BY 1"""


ORACLES["road_length_by_cell"] = _road_length_sql()


def nearest_road(spark, d):
    """Customers' distance to the nearest major road."""
    found = features.nearest_road(customers(spark, d).select("c_custkey", "city", "x", "y"), road_segments(spark, d).where("is_major"), ["c_custkey"])
    return found.select("c_custkey", F.round("dist_major_road_km", 6).alias("dist_major_road_km"))


QUERIES["nearest_road"] = nearest_road
_T = "CASE WHEN dx * dx + dy * dy > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) ELSE 0.0::DOUBLE END"
ORACLES["nearest_road"] = f"""WITH pairs AS (SELECT c.c_custkey, c.x, c.y, s.x1, s.y1, s.x2 - s.x1 AS dx, s.y2 - s.y1 AS dy FROM {placed_sql('customer', 'c_custkey')} c CROSS JOIN {_ROADS} s WHERE s.road_id % 3 = 0),
t AS (SELECT *, {_T} AS t FROM pairs)
SELECT c_custkey, round(min(sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy)))), 6) AS dist_major_road_km FROM t GROUP BY 1"""

#: A bay with an island, on the plane.
BAY = [[(-8.0, -8.0), (6.0, -9.0), (8.0, 2.0), (1.0, 5.0), (-6.0, 1.0)], [(-1.0, -3.0), (3.0, -3.0), (2.0, 0.5)]]


def point_in_polygon_mask(spark, d):
    """The customers' cells that lie outside a bay with an island."""
    cells = occupied(spark, d).withColumn("x", LATTICE.x(F.col("cell"))).withColumn("y", LATTICE.y(F.col("cell")))
    bay = spark.range(1).select(F.lit(0).alias("city"), F.array(*(geo.literal_ring(r) for r in BAY)).alias("rings"))
    return cells.join(features.in_water(cells, bay), ["city", "cell"], "left_anti").select("cell", "n")


QUERIES["point_in_polygon_mask"] = point_in_polygon_mask


def _inside_sql(x: str, y: str) -> str:
    crossings = []
    for ring in BAY:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            crossings.append(f"(CASE WHEN ({y1}::DOUBLE > {y}) <> ({y2}::DOUBLE > {y}) AND {x} < {x1}::DOUBLE + ({y} - {y1}::DOUBLE) * ({x2 - x1}::DOUBLE) / ({y2 - y1}::DOUBLE) THEN 1 ELSE 0 END)")
    return f"(({' + '.join(crossings)}) % 2 = 1)"


_PLACED_CELLS = f"(SELECT *, {LATTICE.edge}::DOUBLE * ({math.sqrt(3)!r}::DOUBLE * q + {math.sqrt(3) / 2!r}::DOUBLE * r) AS x, {LATTICE.edge}::DOUBLE * (1.5::DOUBLE * r) AS y FROM ({_OCCUPIED}))"
ORACLES["point_in_polygon_mask"] = f"SELECT cell, n FROM {_PLACED_CELLS} WHERE NOT {_inside_sql('x', 'y')}"


def polygon_fill(spark, d):
    """The cells of the bay with a ring around them, and which of them customers lie in."""
    bay = spark.range(1).select(F.lit(0).alias("city"), F.array(*(geo.literal_ring(r) for r in BAY)).alias("rings"))
    return features.fill_polygon(bay, LATTICE).join(occupied(spark, d), ["city", "cell"], "left").select("cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


QUERIES["polygon_fill"] = polygon_fill
ORACLES["polygon_fill"] = f"""WITH box AS (SELECT q, r, {LATTICE.edge}::DOUBLE * ({math.sqrt(3)!r}::DOUBLE * q + {math.sqrt(3) / 2!r}::DOUBLE * r) AS x, {LATTICE.edge}::DOUBLE * (1.5::DOUBLE * r) AS y
  FROM (SELECT unnest(range(-40, 41)) AS q) CROSS JOIN (SELECT unnest(range(-40, 41)) AS r)),
inside AS (SELECT ((q + 1048576) * 2097152 + (r + 1048576))::BIGINT AS cell FROM box WHERE {_inside_sql('x', 'y')}), way(o) AS (VALUES {_OFFSETS[1]}),
grid AS (SELECT DISTINCT inside.cell + way.o AS cell FROM inside CROSS JOIN way)
SELECT g.cell, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN ({_OCCUPIED}) c USING (cell)"""


def reachability_mask(spark, d):
    """Suppliers' cells and their surroundings that have a customer, or a road nearby."""
    grid = suppliers(spark, d).select("city", F.explode(hexgrid.disk(LATTICE.cell(F.col("lat"), F.col("lng")), 2)).alias("cell")).distinct()
    roads = features.road_length(road_segments(spark, d), LATTICE)
    cells = grid.join(occupied(spark, d).select("city", "cell", F.col("n").alias("poi_count")), ["city", "cell"], "left").join(roads, ["city", "cell"], "left").fillna(0).withColumn("touches_boundary", F.lit(False))
    return features.reachable(cells).where("reachable").select("cell", "poi_count")


QUERIES["reachability_mask"] = reachability_mask
ORACLES["reachability_mask"] = f"""WITH road AS ({ORACLES['road_length_by_cell']}), way2(o) AS (VALUES {_OFFSETS[2]}), way1(o) AS (VALUES {_OFFSETS[1]}),
grid AS (SELECT DISTINCT cell + o AS cell FROM {_SUPPLIER_CELLS} CROSS JOIN way2), kept AS (SELECT g.cell FROM grid g WHERE g.cell IN (SELECT road.cell + o FROM road JOIN grid USING (cell) CROSS JOIN way1)),
pois AS ({_OCCUPIED})
SELECT g.cell, coalesce(p.n, 0) AS poi_count FROM grid g LEFT JOIN pois p USING (cell) WHERE g.cell IN (FROM kept) OR p.n > 0"""


def town(spark, d):
    return occupied(spark, d).select("city", "cell")


def dense(spark, d):
    """Occupied cells with at least the mean number of customers per cell, plus one."""
    cells = occupied(spark, d)
    mean = cells.agg((F.floor(F.avg("n")) + 1).alias("least"))
    return cells.crossJoin(F.broadcast(mean)).where(F.col("n") >= F.col("least")).select("city", "cell")


_DENSE = f"(SELECT * FROM ({_OCCUPIED}) WHERE n >= (SELECT floor(avg(n)) + 1 FROM ({_OCCUPIED})))"


def components_ring1(spark, d):
    return graph.clusters(dense(spark, d)).select("cell", "component")


QUERIES["components_ring1"] = components_ring1
ORACLES["components_ring1"] = f"""WITH RECURSIVE town AS MATERIALIZED (SELECT cell FROM {_DENSE}), way(o) AS (VALUES {_OFFSETS[1]}), link AS MATERIALIZED (SELECT a.cell, b.cell AS other FROM town a CROSS JOIN way JOIN town b ON b.cell = a.cell + way.o),
reach(cell, seed) AS (SELECT cell, cell FROM town UNION SELECT l.other, r.seed FROM reach r JOIN link l USING (cell))
SELECT cell, min(seed) AS component FROM reach GROUP BY cell"""


def bridged_component(spark, d):
    """What the smallest dense cell reaches when two steps may cross cells without customers."""
    seeds = dense(spark, d).groupBy("city").agg(F.min("cell").alias("cell"))
    return graph.connected(seeds, dense(spark, d), 2, town(spark, d)).select("cell")


QUERIES["bridged_component"] = bridged_component


def _bridge_sql() -> str:
    """Steps of two whose only cell between, from the smaller id, is no land."""
    rows = []
    for q, r in hexgrid.offsets(2):
        n = (abs(q) + abs(r) + abs(q + r)) // 2
        if q * _STEP + r <= 0 or n == 0:
            continue
        if n == 1:
            rows.append(f"({q * _STEP + r}, NULL)")
        else:
            fq, fr = q / 2 + 1e-6, r / 2 + 2e-6
            a, b, c = (math.floor(v + 0.5) for v in (fq, fr, -fq - fr))
            da, db, dc = abs(a - fq), abs(b - fr), abs(c + fq + fr)
            mq, mr = (-b - c, b) if da > db and da > dc else (a, -a - c) if db > dc else (a, b)
            rows.append(f"({q * _STEP + r}, {mq * _STEP + mr})")
    return ", ".join(rows)


ORACLES["bridged_component"] = f"""WITH RECURSIVE land AS MATERIALIZED (SELECT cell FROM ({_OCCUPIED})), town AS MATERIALIZED (SELECT cell FROM {_DENSE}), way(o, mid) AS (VALUES {_bridge_sql()}),
half AS (SELECT a.cell, b.cell AS other FROM town a CROSS JOIN way JOIN town b ON b.cell = a.cell + way.o WHERE way.mid IS NULL OR a.cell + way.mid NOT IN (FROM land)),
link AS MATERIALIZED (SELECT * FROM half UNION ALL SELECT other, cell FROM half),
reach(cell) AS (SELECT min(cell) FROM town UNION SELECT l.other FROM reach JOIN link l USING (cell))
SELECT cell FROM reach"""


def metro_cells(spark, d):
    """Customers' cells with what delineation needs, suppliers being roads."""
    cells = occupied(spark, d).withColumn("x", LATTICE.x(F.col("cell"))).withColumn("y", LATTICE.y(F.col("cell")))
    roads = features.road_length(road_segments(spark, d), LATTICE)
    pull = features.gravity(cells, suppliers(spark, d), 1.5, ["cell"])
    cells = cells.join(roads, ["city", "cell"], "left").join(pull, "cell", "left").fillna(0.0)
    return cells.withColumn("poi_count", F.col("n")).withColumn("dist_cbd_km", geo.distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0)))


def metro_delineation(spark, d):
    cells = metro_cells(spark, d)
    centre = spark.range(1).select(F.lit(0).alias("city"), hexgrid.pack(F.lit(0), F.lit(0)).alias("cell"))
    metro = DEFAULTS["metro"] | {"min_poi_per_cell": 5.0, "connector_min_component_cells": 3, "connector_min_road_km_per_cell": 0.1, "connector_min_establishment_access": 0.5}
    found = graph.delineate(cells, centre, metro)
    return found.select("cell", "is_urban", "is_connector", "in_metro")


QUERIES["metro_delineation"] = metro_delineation


def urban_predicate(spark, d):
    cells = metro_cells(spark, d)
    return cells.select("cell", graph.urban(cells, 6.0, 0.5, 1.0).alias("is_urban"))


QUERIES["urban_predicate"] = urban_predicate


def _urban_sql(poi: float, road: float, access: float) -> str:
    """The occupied cells with x, y and is_urban."""
    return f"""SELECT c.cell, c.x, c.y, (c.n >= {poi} OR (coalesce(road.road_density_km, 0) >= {road} AND coalesce(pull.ea, 0) >= {access})) AS is_urban FROM {_PLACED_CELLS} c
LEFT JOIN ({ORACLES['road_length_by_cell']}) road USING (cell) LEFT JOIN (SELECT c.cell, sum(((s.s_nationkey % 5 + 1) / 5::DOUBLE) * exp(-sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) / 1.5::DOUBLE)) AS ea
  FROM {_PLACED_CELLS} c CROSS JOIN {placed_sql('supplier', 's_suppkey')} s GROUP BY 1) pull USING (cell)"""


ORACLES["urban_predicate"] = f"SELECT cell, is_urban FROM ({_urban_sql(6.0, 0.5, 1.0)})"
#: A metro without connectors: what the seed reaches over urban cells and bridges.
CORE = DEFAULTS["metro"] | {"min_poi_per_cell": 5.0, "min_road_km_per_cell": 0.5, "min_establishment_access_for_road_cell": 1.0, "bridge_gap": 2, "connector_gap": 0}


def metro_core(spark, d):
    centre = spark.range(1).select(F.lit(0).alias("city"), hexgrid.pack(F.lit(0), F.lit(0)).alias("cell"))
    return graph.delineate(metro_cells(spark, d), centre, CORE).select("cell", "is_urban", "in_metro")


QUERIES["metro_core"] = metro_core
ORACLES["metro_core"] = f"""WITH RECURSIVE land AS MATERIALIZED ({_urban_sql(5.0, 0.5, 1.0)}), town AS MATERIALIZED (SELECT * FROM land WHERE is_urban), way(o, mid) AS (VALUES {_bridge_sql()}),
half AS (SELECT a.cell, b.cell AS other FROM town a CROSS JOIN way JOIN town b ON b.cell = a.cell + way.o WHERE way.mid IS NULL OR a.cell + way.mid NOT IN (SELECT cell FROM land)),
link AS MATERIALIZED (SELECT * FROM half UNION ALL SELECT other, cell FROM half),
seed AS (SELECT cell FROM town ORDER BY cell <> (1048576 * 2097152::BIGINT + 1048576), sqrt(x * x + y * y), cell LIMIT 1),
reach(cell) AS (SELECT cell FROM seed UNION SELECT l.other FROM reach JOIN link l USING (cell))
SELECT cell, is_urban, cell IN (FROM reach) AS in_metro FROM land"""


def extent_and_area(spark, d):
    """Bounds of each nation's customers, and the area of the cells they lie in."""
    own = customers(spark, d).withColumn("cell", LATTICE.cell(F.col("lat"), F.col("lng")))
    return own.groupBy("c_nationkey").agg(F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"), F.round(F.count_distinct("cell") * LATTICE.cell_area, 6).alias("area_km2"))


QUERIES["extent_and_area"] = extent_and_area
ORACLES["extent_and_area"] = f"SELECT c_nationkey, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north, round(count(DISTINCT cell) * {LATTICE.cell_area!r}::DOUBLE, 6) AS area_km2 FROM {_CUSTOMER_CELLS} GROUP BY 1"


def ring_measures(spark, d):
    """Area, centroid and vertex mean of a triangle at each supplier."""
    x, y = F.col("x"), F.col("y")
    ring = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 1 + F.col("s_nationkey")).alias("x"), y.alias("y")), F.struct(x.alias("x"), (y + 2).alias("y")))
    df = suppliers(spark, d).withColumn("ring", ring)
    c, m = geo.ring_centroid(F.col("ring")), geo.vertex_mean(F.col("ring"))
    return df.select("s_suppkey", F.round(geo.ring_area(F.col("ring")), 6).alias("area"), F.round(c["x"], 5).alias("cx"), F.round(c["y"], 5).alias("cy"), F.round(m["x"], 5).alias("mx"), F.round(geo.ring_distance(x - 3, y, F.col("ring")), 6).alias("off"))


QUERIES["ring_measures"] = ring_measures
ORACLES["ring_measures"] = f"""SELECT s_suppkey, round((1 + s_nationkey)::DOUBLE, 6) AS area, round(x + (1 + s_nationkey) / 3::DOUBLE, 5) AS cx, round(y + 2 / 3::DOUBLE, 5) AS cy,
round(x + (1 + s_nationkey) / 3::DOUBLE, 5) AS mx, 3.0::DOUBLE AS off FROM {placed_sql('supplier', 's_suppkey')}"""


def metro_outline(spark, d):
    """The sides of dense cells that no other dense cell shares: the outline of the town."""
    return sinks.outline(dense(spark, d)).select("cell", "side")


QUERIES["metro_outline"] = metro_outline
ORACLES["metro_outline"] = f"""WITH town AS (SELECT cell FROM {_DENSE}), way(side, o) AS (VALUES {', '.join(f'({i}, {q * _STEP + r})' for i, (q, r) in enumerate(hexgrid.RING))})
SELECT cell, side::INT AS side FROM town CROSS JOIN way WHERE cell + o NOT IN (FROM town)"""


def city_cells(spark, d):
    """(city, cell, n): the cells that each nation's customers lie in."""
    own = placed(table(spark, d, "customer"), "c_custkey", "c_nationkey").withColumn("cell", LATTICE.cell(F.col("lat"), F.col("lng")))
    return own.groupBy("city", "cell").agg(F.count("*").alias("n"))


_CITY_CELLS = f"(SELECT city, cell, q, r, count(*) AS n FROM {celled_sql(placed_sql('customer', 'c_custkey', 'c_nationkey'))} GROUP BY ALL)"


def metro_polygon(spark, d):
    """Each nation's cells as polygons: their number, holes, sides and the area of their rings."""
    found = sinks.polygons(city_cells(spark, d), LATTICE)
    total = lambda of: F.aggregate(of, F.lit(0.0), lambda s, v: s + v)
    areas = F.transform("rings", geo.ring_area)
    return found.groupBy("city").agg(
        F.count("*").alias("polygons"), F.sum(F.size("rings") - 1).alias("holes"), F.sum(F.size(F.flatten("rings"))).alias("sides"),
        F.round(F.sum(2 * F.element_at(areas, 1) - total(areas)), 6).alias("area_km2"),
    )


QUERIES["metro_polygon"] = metro_polygon
#: Holes by Euler's formula: parts less holes are corners less sides plus cells.
ORACLES["metro_polygon"] = f"""WITH RECURSIVE town AS MATERIALIZED (SELECT * FROM {_CITY_CELLS}), way(o) AS (VALUES {', '.join(f'({q * _STEP + r})' for q, r in hexgrid.RING)}),
link AS MATERIALIZED (SELECT a.city, a.cell, b.cell AS other FROM town a CROSS JOIN way JOIN town b ON b.city = a.city AND b.cell = a.cell + way.o),
reach(city, cell, seed) AS (SELECT city, cell, cell FROM town UNION SELECT l.city, l.other, r.seed FROM reach r JOIN link l USING (city, cell)),
parts AS (SELECT city, count(DISTINCT least_seed) AS k FROM (SELECT city, cell, min(seed) AS least_seed FROM reach GROUP BY 1, 2) GROUP BY 1),
corners AS (SELECT city, count(DISTINCT (2 * q + r + dx, 3 * r + dy)) AS v FROM town CROSS JOIN (VALUES (1, -1), (1, 1), (0, 2), (-1, 1), (-1, -1), (0, -2)) w(dx, dy) GROUP BY 1),
shared AS (SELECT city, count(*) // 2 AS m FROM link GROUP BY 1), cells AS (SELECT city, count(*) AS f FROM town GROUP BY 1)
SELECT city, k AS polygons, (k - (v - (6 * f - coalesce(m, 0)) + f))::BIGINT AS holes, (6 * f - 2 * coalesce(m, 0))::BIGINT AS sides, round(f * {LATTICE.cell_area!r}::DOUBLE, 6) AS area_km2
FROM cells JOIN parts USING (city) JOIN corners USING (city) LEFT JOIN shared USING (city)"""


def city_summary(spark, d):
    """The summary record of each nation, its cells with several customers being the metro."""
    cells = city_cells(spark, d).withColumn("lat", LATTICE.lat(F.col("cell"))).withColumn("lng", LATTICE.lng(F.col("cell")))
    return sinks.summary(cells.withColumn("in_metro", F.col("n") > 1).withColumn("is_connector", F.col("n") == 2).withColumnRenamed("n", "poi_count"), LATTICE)


QUERIES["city_summary"] = city_summary
_LAT = f"({LATTICE.edge}::DOUBLE * (1.5::DOUBLE * r)) / {_KY}::DOUBLE + {ORIGIN[0]}::DOUBLE"
_LNG = f"({LATTICE.edge}::DOUBLE * ({math.sqrt(3)!r}::DOUBLE * q + {math.sqrt(3) / 2!r}::DOUBLE * r)) / {_KX}::DOUBLE + {ORIGIN[1]}::DOUBLE"
ORACLES["city_summary"] = f"""SELECT city, count(*) AS n_land, count(*) FILTER (n > 1) AS n_metro, count(*) FILTER (n = 2) AS n_connectors, sum(n)::BIGINT AS n_pois,
round(count(*) * {LATTICE.cell_area!r}::DOUBLE, 1) AS land_km2, round(count(*) FILTER (n > 1) * {LATTICE.cell_area!r}::DOUBLE, 1) AS metro_km2,
round(min({_LNG}), 5) AS west, round(min({_LAT}), 5) AS south, round(max({_LNG}), 5) AS east, round(max({_LAT}), 5) AS north FROM {_CITY_CELLS} GROUP BY city"""


def components_by_city(spark, d):
    """The clusters of each nation's cells; nations overlap on the map, their cells do not join."""
    return graph.clusters(city_cells(spark, d)).select("city", "cell", "component")


QUERIES["components_by_city"] = components_by_city
ORACLES["components_by_city"] = f"""WITH RECURSIVE town AS MATERIALIZED (SELECT city, cell FROM {_CITY_CELLS}), way(o) AS (VALUES {_OFFSETS[1]}),
link AS MATERIALIZED (SELECT a.city, a.cell, b.cell AS other FROM town a CROSS JOIN way JOIN town b ON b.city = a.city AND b.cell = a.cell + way.o),
reach(city, cell, seed) AS (SELECT city, cell, cell FROM town UNION SELECT l.city, l.other, r.seed FROM reach r JOIN link l USING (city, cell))
SELECT city, cell, min(seed) AS component FROM reach GROUP BY 1, 2"""


def downtown_by_city(spark, d):
    """Downtown of each nation's cells, its customers being establishments and its suppliers roads."""
    roads = placed(table(spark, d, "supplier"), "s_suppkey", "s_nationkey").groupBy("city", LATTICE.cell(F.col("lat"), F.col("lng")).alias("cell")).agg(F.count("*").cast("double").alias("road_density_km"))
    cells = city_cells(spark, d).select("city", "cell", F.col("n").cast("double").alias("poi_weighted_density")).join(roads, ["city", "cell"], "left").fillna(0.0, ["road_density_km"])
    found = features.downtown(cells.withColumn("lat", LATTICE.lat(F.col("cell"))).withColumn("lng", LATTICE.lng(F.col("cell"))))
    return found.select("city", "cell", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


QUERIES["downtown_by_city"] = downtown_by_city
ORACLES["downtown_by_city"] = f"""WITH cells AS (SELECT a.*, coalesce(b.m, 0)::DOUBLE AS km FROM {_CITY_CELLS} a LEFT JOIN (SELECT city, cell, count(*) AS m FROM {celled_sql(placed_sql('supplier', 's_suppkey', 's_nationkey'))} GROUP BY 1, 2) b USING (city, cell)),
scored AS (SELECT *, 0.8::DOUBLE * ({rank_sql('km', 'city', True)}) + 0.2::DOUBLE * ({rank_sql('n', 'city', True)}) AS score FROM cells), way(o) AS (VALUES {_OFFSETS[2]}),
smooth AS (SELECT a.city, a.cell, any_value(a.q) AS q, any_value(a.r) AS r, avg(b.score) AS s FROM scored a CROSS JOIN way JOIN scored b ON b.city = a.city AND b.cell = a.cell + way.o GROUP BY 1, 2)
SELECT city, cell, round({_LAT}, 6) AS lat, round({_LNG}, 6) AS lng FROM smooth QUALIFY row_number() OVER (PARTITION BY city ORDER BY round(s, 9) DESC, cell) = 1"""


def access_by_city(spark, d):
    """Gravity and the nearest supplier of customers among the suppliers of their own nation only."""
    own = placed(table(spark, d, "customer"), "c_custkey", "c_nationkey").select("c_custkey", "city", "x", "y")
    give = placed(table(spark, d, "supplier"), "s_suppkey", "s_nationkey").withColumn("weight", (F.col("s_suppkey") % 5 + 1) / F.lit(5.0))
    pull = features.gravity(own, give, SCALES["establishment"], ["c_custkey"])
    points = give.select("s_suppkey", "city", F.col("x").alias("px"), F.col("y").alias("py"))
    near = features.nearest_point(own, points, "c_custkey", "s_suppkey", 8.0, geo.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")))
    found = own.join(pull, "c_custkey", "left").join(near, "c_custkey", "left")
    return found.select("c_custkey", "city", F.round("establishment_access", 6).alias("establishment_access"), "s_suppkey", F.round("distance", 6).alias("distance_km"))


QUERIES["access_by_city"] = access_by_city
ORACLES["access_by_city"] = f"""WITH c AS (SELECT c_custkey, city, x, y FROM {placed_sql('customer', 'c_custkey', 'c_nationkey')}),
pairs AS (SELECT c.c_custkey, s.s_suppkey, (s.s_suppkey % 5 + 1) / 5::DOUBLE AS w, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS km FROM c JOIN {placed_sql('supplier', 's_suppkey', 's_nationkey')} s ON s.city = c.city),
pull AS (SELECT c_custkey, sum(w * exp(-km / {SCALES['establishment']}::DOUBLE)) AS ea FROM pairs WHERE km <= {SCALES['establishment'] * features.CUTOFF}::DOUBLE GROUP BY 1),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) = 1)
SELECT c.c_custkey, c.city, round(ea, 6) AS establishment_access, s_suppkey, round(km, 6) AS distance_km FROM c LEFT JOIN pull USING (c_custkey) LEFT JOIN near USING (c_custkey)"""


def poi_layer(spark, d):
    """Customers as establishments of their nation, at most 20 a nation on the map; the limit is the feature."""
    pois = placed(table(spark, d, "customer"), "c_custkey", "c_nationkey").withColumnRenamed("c_mktsegment", "category")
    at = lambda path: F.get_json_object("feature", path)
    return sinks.poi_features(pois, 20).select("city", at("$.properties.cat").alias("category"), at("$.geometry.coordinates[0]").cast("double").alias("lng"), at("$.geometry.coordinates[1]").cast("double").alias("lat"))


QUERIES["poi_layer"] = poi_layer
ORACLES["poi_layer"] = f"""SELECT city, c_mktsegment AS category, round(lng, 5) AS lng, round(lat, 5) AS lat FROM {placed_sql('customer', 'c_custkey', 'c_nationkey')}
QUALIFY row_number() OVER (PARTITION BY city ORDER BY md5(concat_ws('|', round(lng * 100000)::BIGINT, round(lat * 100000)::BIGINT, c_mktsegment)), c_custkey) <= 20"""

_PRICED = "city % 2 = 0 AND n > 1"


def cells_geojson(spark, d):
    """Each nation's cells as features of a GeoJSON layer, read again: short keys, rounded values,
    price keys only in nations of even keys that have a priced cell."""
    names = [c for _, c, _ in sinks.CELL_PROPERTIES]
    cells = city_cells(spark, d).withColumns({c: F.col("n") / F.lit(float(7 + 2 * i)) for i, c in enumerate(names)})
    cells = cells.withColumns({c: F.when(F.expr(_PRICED), 1000.0 * (i + 1) + F.col("n")) for i, (_, c) in enumerate(sinks.PRICE_PROPERTIES)})
    cells = cells.withColumn("poi_count", F.col("n")).withColumn("in_metro", F.col("n") > 1).withColumn("is_connector", F.col("n") == 2)
    found = sinks.cell_features(cells, LATTICE)
    at = lambda path, kind: F.get_json_object("feature", path).cast(kind)
    ring = "$.geometry.coordinates[0]"
    return found.select(
        "city", at("$.properties.id", "bigint").alias("cell"), *(at(f"$.properties.{k}", "double").alias(k) for k, _, _ in sinks.CELL_PROPERTIES), *(at(f"$.properties.{k}", "bigint").alias(k) for k in ("pc", "mt", "cn")),
        *(at(f"$.properties.{k}", "double").alias(k) for k, _ in sinks.PRICE_PROPERTIES), F.contains("feature", F.lit('"ppsm"')).alias("has_price_key"),
        F.size(F.from_json(F.get_json_object("feature", ring), "array<array<double>>")).alias("corners"), *(F.round(at(f"{ring}[1][{i}]", "double"), 6).alias(n) for i, n in enumerate(("east", "north"))),
    )


QUERIES["cells_geojson"] = cells_geojson


def _cells_geojson_sql() -> str:
    values = ", ".join(f"round(n / {7 + 2 * i}::DOUBLE, {k}) AS {short}" for i, (short, _, k) in enumerate(sinks.CELL_PROPERTIES))
    prices = ", ".join(f"CASE WHEN {_PRICED} THEN {1000 * (i + 1)}::DOUBLE + n END AS {short}" for i, (short, _) in enumerate(sinks.PRICE_PROPERTIES))
    x = f"({LATTICE.edge}::DOUBLE * ({math.sqrt(3)!r}::DOUBLE * q + {math.sqrt(3) / 2!r}::DOUBLE * r) + {LATTICE.edge * math.sqrt(3) / 2!r}::DOUBLE)"
    y = f"({LATTICE.edge}::DOUBLE * (1.5::DOUBLE * r) + {LATTICE.edge / 2!r}::DOUBLE)"
    return f"""SELECT city, cell, {values}, n AS pc, (n > 1)::BIGINT AS mt, (n = 2)::BIGINT AS cn, {prices}, bool_or({_PRICED}) OVER (PARTITION BY city) AS has_price_key, 7 AS corners,
round({x} / {_KX}::DOUBLE + {ORIGIN[1]}::DOUBLE, 6) AS east, round({y} / {_KY}::DOUBLE + {ORIGIN[0]}::DOUBLE, 6) AS north FROM {_CITY_CELLS}"""


ORACLES["cells_geojson"] = _cells_geojson_sql()


def map_layers(spark, d):
    """Suppliers as map features: their category's colour, and the layers that show them."""
    names = [*sinks.CATEGORY_COLOURS, "other", None]
    category = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("s_nationkey") % len(names) + 1).cast("int"))
    metro, link = F.col("s_acctbal") > 3000, F.col("s_acctbal").between(0, 1000)
    return table(spark, d, "supplier").select(
        "s_suppkey", sinks.category_colour(category).alias("colour"), sinks.cells_shown(metro, False, False).alias("value_view"), sinks.cells_shown(metro, True, False).alias("metro_view"),
        sinks.cells_shown(metro, True, True).alias("metro_only"), sinks.connectors_shown(link, True, True).alias("connectors"), sinks.connectors_shown(link, False, True).alias("connectors_elsewhere"),
    )


QUERIES["map_layers"] = map_layers
ORACLES["map_layers"] = f"""SELECT s_suppkey, CASE s_nationkey % 10 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(sinks.CATEGORY_COLOURS.values()))} ELSE '#888' END AS colour,
s_acctbal > 3000 AS value_view, true AS metro_view, s_acctbal > 3000 AS metro_only, s_acctbal BETWEEN 0 AND 1000 AS connectors, false AS connectors_elsewhere FROM supplier"""
