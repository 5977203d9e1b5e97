"""Writers: parquet, CSV, GeoJSON layers, summaries and the manifest of cities."""

from __future__ import annotations

import json
import math
import threading
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COMPONENTS, Config, normalised_weights
from ..functions import hexgrid
from ..functions.hexgrid import Lattice
from ..operators import graph, relational, stats

#: Labels of the components, and the metrics of a map.
COMPONENT_LABELS = ("Downtown", "Major road", "Establishments", "POI density", "Road density")
METRICS = (("lv", "Land value index"), ("rvs", "Value share"), ("bs", "Built-up score"), ("ea", "Establishment access"), ("dcbd", "Distance to downtown"))
PRICE_METRIC = ("ppsm", "Commercial land price")
#: The colour of each category of establishments on a map, and that of any other.
CATEGORY_COLOURS = {
    "mall": "#e6194B", "office": "#4363d8", "transport": "#3cb44b", "school": "#f58231",
    "hospital": "#911eb4", "government": "#42d4f4", "bank": "#bfef45", "leisure": "#469990",
}
OTHER_COLOUR = "#888"
#: The short key, column and decimals of each property of a cell.
CELL_PROPERTIES = (
    ("lv", "land_value_index", 2), ("rvs", "relative_value_share", 8), *((f"c{i}", f"norm_{c}", 4) for i, c in enumerate(COMPONENTS)), ("ea", "establishment_access", 3),
    ("pwd", "poi_weighted_density", 3), ("rdk", "road_density_km", 3), ("dcbd", "dist_cbd_km", 3), ("bs", "builtup_score", 4),
)
PRICE_PROPERTIES = (("ppsm", "land_price_php_sqm"), ("plo", "land_price_low_php_sqm"), ("phi", "land_price_high_php_sqm"))


def write_features(df: DataFrame, path: str) -> None:
    """Features as parquet, a folder per city, so that a reader of one city opens only its own."""
    df.write.mode("overwrite").partitionBy("city").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header: for tables of labels or areas, not of cells."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def feature(properties: Column, geometry: Column) -> Column:
    return F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))


def point(lng: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))


def polygon(ring: Column, lattice: Lattice) -> Column:
    """A closed ring of the plane's points as longitudes and latitudes."""
    from ..functions import geo

    at = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(geo.lng_of(p["x"], lattice.origin), geo.lat_of(p["y"], lattice.origin)))
    return F.struct(F.lit("Polygon").alias("type"), F.array(at).alias("coordinates"))


def cell_features(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """(city, feature): a GeoJSON feature per cell. Price keys appear only in cities where
    some cell has a price."""
    df = stats.with_group(cells, ["city"], _priced=F.max(F.col("land_price_php_sqm").isNotNull())) if "land_price_php_sqm" in cells.columns else cells
    base = [F.col("cell").cast("string").alias("id"), *(F.round(c, n).alias(k) for k, c, n in CELL_PROPERTIES), F.col("poi_count").alias("pc"), F.col("in_metro").cast("int").alias("mt"), F.col("is_connector").cast("int").alias("cn")]
    geometry = polygon(lattice.ring(F.col("cell")), lattice)
    plain = F.to_json(feature(F.struct(*base), geometry))
    if "land_price_php_sqm" not in cells.columns:
        return df.select("city", plain.alias("feature"))
    priced = F.to_json(feature(F.struct(*base, *(F.round(c, 0).alias(k) for k, c in PRICE_PROPERTIES)), geometry), {"ignoreNullFields": "false"})
    return df.select("city", F.when(F.col("_priced"), priced).otherwise(plain).alias("feature"))


def water_features(grid: DataFrame, land: DataFrame, water: DataFrame, lattice: Lattice) -> DataFrame:
    """(city, feature): the cells that are no land, and the mapped water."""
    left = grid.join(land.select("city", "cell"), ["city", "cell"], "left_anti")
    excluded = left.select("city", F.to_json(feature(F.struct(F.col("cell").cast("string").alias("id"), F.lit("excluded_cell").alias("kind")), polygon(lattice.ring(F.col("cell")), lattice))).alias("feature"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.flatten(F.transform("rings", lambda r: polygon(r, lattice)["coordinates"])).alias("coordinates"))
    mapped = water.select("city", F.to_json(feature(F.struct(F.concat(F.lit("water_"), F.xxhash64("rings").cast("string")).alias("id"), F.lit("mapped_water").alias("kind")), shape)).alias("feature"))
    return excluded.unionByName(mapped)


def outline(cells: DataFrame) -> DataFrame:
    """(city, cell, side): the sides of cells that no other of them shares."""
    step = 1 << 21
    sides = cells.select("city", "cell", F.posexplode(F.array(*(F.col("cell") + (q * step + r) for q, r in hexgrid.RING))).alias("side", "other"))
    return sides.join(cells.select("city", F.col("cell").alias("other")), ["city", "other"], "left_anti")


#: A cell's corners, turning left, in steps of half a cell's width and a quarter of its height.
CORNERS = ((1, -1), (1, 1), (0, 2), (-1, 1), (-1, -1), (0, -2))


def polygons(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """(city, component, rings): a polygon for each connected part of (city, cell), its
    outside first, then its holes, as points x and y of the plane without the first one
    again. A part's outline is one value in the end, so one task chains it; a city's parts
    and all cities go to tasks of their own."""

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        """The rings of one component's sides. Cells that touch share a side, so each corner of
        the outline has one side that leaves it, and one ring, the only left turning one, is
        outside."""
        leave = dict(zip(zip(part["ax"], part["ay"]), zip(part["bx"], part["by"])))
        rings = []
        for at in sorted(leave):
            ring = []
            while at in leave:
                ring.append(at)
                at = leave.pop(at)
            if ring:
                rings.append(ring)
        twice = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))
        rings.sort(key=lambda ring: (twice(ring) < 0, ring[0]))
        points = [[{"x": int(x), "y": int(y)} for x, y in ring] for ring in rings]
        return pd.DataFrame({"city": [part["city"].iloc[0]], "component": [part["component"].iloc[0]], "rings": [points]})

    parts = graph.clusters(cells.select("city", "cell"))
    q, r = hexgrid.q_of(F.col("cell")), hexgrid.r_of(F.col("cell"))
    corner = lambda i, axis: F.element_at(F.array(*(F.lit(c[axis]) for c in CORNERS)), i.cast("int") + 1)
    at = lambda i, name: [(2 * q + r + corner(i, 0)).alias(f"{name}x"), (3 * r + corner(i, 1)).alias(f"{name}y")]
    sides = outline(parts).join(parts, ["city", "cell"]).select("city", "component", *at(F.col("side"), "a"), *at((F.col("side") + 1) % 6, "b"))
    kinds = dict(sides.dtypes)
    found = sides.groupBy("city", "component").applyInPandas(chained, f"city {kinds['city']}, component {kinds['component']}, rings array<array<struct<x:bigint,y:bigint>>>")
    width, height = lattice.edge * math.sqrt(3) / 2, lattice.edge / 2
    plane = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"))))
    return found.withColumn("rings", plane)


def metro_features(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """(city, feature): the metro as a polygon, or as several where it has several parts,
    with its cells and area. Its border is that of the cells; 150 m closing, which rounds
    it, is not drawn."""
    metro = cells.where("in_metro").select("city", "cell")
    closed = F.transform("rings", lambda ring: polygon(ring, lattice)["coordinates"][0])
    shapes = polygons(metro, lattice).select("city", "component", closed.alias("rings")).groupBy("city").agg(F.sort_array(F.collect_list(F.struct("component", "rings"))).alias("parts"))
    sizes = metro.groupBy("city").agg(F.count("*").alias("cells"))
    properties = F.struct(F.lit("metro_area").alias("name"), "cells", F.round(F.col("cells") * lattice.cell_area, 1).alias("area_km2"))
    one = F.struct(F.lit("Polygon").alias("type"), F.col("parts")[0]["rings"].alias("coordinates"))
    many = F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts.rings").alias("coordinates"))
    return shapes.join(sizes, "city").select("city", F.when(F.size("parts") == 1, F.to_json(feature(properties, one))).otherwise(F.to_json(feature(properties, many))).alias("feature"))


def category_colour(category: Column) -> Column:
    """The colour of an establishment's category on a map."""
    known = F.create_map(*(F.lit(v) for pair in CATEGORY_COLOURS.items() for v in pair))
    return F.coalesce(F.try_element_at(known, category), F.lit(OTHER_COLOUR))


def cells_shown(in_metro: Column, metro_view: bool, metro_only: bool) -> Column:
    """Whether a map's cell layer shows a cell: outside the metro only in the metro's own
    view, with the switch off."""
    return F.lit(metro_view and not metro_only) | F.coalesce(in_metro, F.lit(False))


def connectors_shown(connector: Column, metro_view: bool, switched_on: bool) -> Column:
    """Whether a map's connector layer shows a cell."""
    return F.lit(metro_view and switched_on) & F.coalesce(connector, F.lit(False))


def poi_features(pois: DataFrame, most: int = 4000) -> DataFrame:
    """(city, feature) of at most `most` establishments of each city, the same ones each time."""
    few = pois.select("city", "category", "lng", "lat", *(F.round(F.col(c) * 100_000).cast("long").alias(f"_{c}") for c in ("lng", "lat")))
    few = relational.sample_per(few, most, ["city"], "_lng", "_lat", "category")
    return few.select("city", F.to_json(feature(F.struct(F.col("category").alias("cat")), point(F.round("lng", 5), F.round("lat", 5)))).alias("feature"))


def write_layer(features: DataFrame, path: str) -> None:
    """One line per feature, a folder per city."""
    features.write.mode("overwrite").partitionBy("city").text(path)


def collection(path: str, features: list[str]) -> None:
    """A FeatureCollection file of features that fit one place (one city's layer)."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text('{"type":"FeatureCollection","features":[' + ",".join(features) + "]}")


def summary(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """A row per city: counts, areas, bounds and price figures."""
    has = lambda c: c in cells.columns
    area = lambda n: F.round(n * lattice.cell_area, 1)
    prices = [F.count("land_price_php_sqm").alias("n_price_cells"), F.max("land_price_market_baseline_php_sqm").alias("price_market_baseline_php_sqm"), F.max("price_source").alias("price_market_baseline_source"), F.max("price_interval").alias("price_interval_method")] if has("land_price_php_sqm") else []
    return cells.groupBy("city").agg(
        F.count("*").alias("n_land"), F.count_if(F.col("in_metro")).alias("n_metro"), F.count_if(F.col("is_connector")).alias("n_connectors"), F.sum("poi_count").alias("n_pois"),
        area(F.count("*")).alias("land_km2"), area(F.count_if(F.col("in_metro"))).alias("metro_km2"),
        *(F.round(f(c), 5).alias(n) for n, f, c in (("west", F.min, "lng"), ("south", F.min, "lat"), ("east", F.max, "lng"), ("north", F.max, "lat"))), *prices,
    )


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registered cities with the incoming ones in place of those of the same slug."""
    return relational.prefer(incoming, existing, "slug")


def registered(existing: DataFrame | None, incoming: DataFrame, replace: bool = False) -> DataFrame:
    """The incoming cities alone only where replacing is asked for."""
    return incoming if replace or existing is None else upsert(existing, incoming)


_LOCK = threading.Lock()


def manifest(config: Config, cities: list[dict], weights_model: dict | None = None) -> dict:
    """The document a map reads first; the price metric leads once some city is priced."""
    metrics = [list(m) for m in METRICS]
    if any(c.get("n_price_cells") for c in cities):
        metrics.insert(0, list(PRICE_METRIC))
    trained = (weights_model or {}).get("weights") if (weights_model or {}).get("status") == "trained" else None
    return {
        "cities": sorted(cities, key=lambda c: c["name"]), "components": list(COMPONENTS), "component_labels": list(COMPONENT_LABELS),
        "weights_default": normalised_weights(trained or config.landvalue["weights"]), "weights_model": weights_model or {"status": "not_trained"}, "metrics": metrics, "poi_categories": list(config.poi_categories),
    }


def register(path: str | Path, config: Config, cities: list[dict], replace: bool = False, weights_model: dict | None = None) -> dict:
    """Adds cities to the manifest file, or replaces it; one writer at a time."""
    with _LOCK:
        path = Path(path)
        old = json.loads(path.read_text())["cities"] if path.exists() and not replace else []
        own = {c["slug"] for c in cities}
        out = manifest(config, [c for c in old if c["slug"] not in own] + cities, weights_model)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(out))
        return out
