"""The whole run: from a city's layers to scored, delineated and priced cells."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geo
from ..functions.hexgrid import Lattice
from ..operators import economics, features, graph, landvalue, pricing
from ..sources.readers import City, load_city
from ..storage import keep


@dataclass(frozen=True)
class Result:
    cells: DataFrame
    downtowns: DataFrame
    grid: DataFrame
    metadata: DataFrame


def build_features(city: City, config: Config, lattice: Lattice, progress: Callable[[float, str], None] = lambda share, text: None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, downtowns, grid): cheap features first, then the mask, then access on land only."""
    progress(0.80, "grid")
    grid = features.fill_polygon(city.region, lattice)
    progress(0.85, "establishments and roads")
    cells = features.poi_counts(grid, city.pois, lattice, list(config.poi_categories))
    segments = features.segments(city.roads)
    cells = cells.join(features.road_length(segments, lattice), ["city", "cell"], "left").fillna(0.0, ["road_density_km"])
    rings = city.boundary.select("city", F.col("rings").alias("_rings"))
    cells = cells.join(F.broadcast(rings), "city", "left").withColumn("touches_boundary", F.coalesce(features.touches(lattice.ring(F.col("cell")), F.col("_rings")), F.lit(False))).drop("_rings")
    progress(0.90, "water")
    cells = keep(features.land(cells, city.water, config.water["require_reachable"]).drop("touches_boundary"))
    progress(0.94, "downtown and access")
    pinned = config.cbd
    if pinned["lat"] is not None and pinned["lng"] is not None:
        centre = lattice.cell(F.lit(float(pinned["lat"])), F.lit(float(pinned["lng"])))
        downtowns = keep(cells.select("city").distinct().select("city", centre.alias("cell"), F.lit(float(pinned["lat"])).alias("lat"), F.lit(float(pinned["lng"])).alias("lng")))
    else:
        downtowns = keep(features.downtown(cells))
    at = downtowns.select("city", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    cells = cells.join(F.broadcast(at), "city").withColumn("dist_cbd_km", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))).drop("_lat", "_lng")
    cells = features.nearest_road(keep(cells), segments.where("is_major"), ["city", "cell"])
    pull = features.gravity(cells, city.pois.select("city", "x", "y", "weight"), config.landvalue["decay_scale_km"]["establishment"], ["city", "cell"])
    cells = cells.join(pull, ["city", "cell"], "left").fillna(0.0, ["establishment_access"])
    return keep(cells.withColumn("area_sqm", F.lit(lattice.cell_area * 1e6)).withColumn("data_source", F.lit(city.source))), downtowns, grid


def run_model(cells: DataFrame, downtowns: DataFrame, config: Config, weights: dict | None = None) -> DataFrame:
    """cells with land value, built-up score and metro."""
    scored = landvalue.land_value(cells, config.landvalue["decay_scale_km"], weights or config.landvalue["weights"], ["city"])
    scored = keep(landvalue.builtup(scored, config.metro["builtup_weights"], ["city"]))
    return keep(graph.delineate(scored, downtowns, config.metro))


def run(spark: SparkSession, config: Config | None = None, city: City | None = None, places: DataFrame | None = None, reference: DataFrame | None = None, observations: DataFrame | None = None, weights: dict | None = None, lattice: Lattice | None = None, progress: Callable[[float, str], None] = lambda share, text: None) -> Result:
    """Everything for one or many cities at once. places: city, place; reference: an
    economic reference table; observations: normalised market observations."""
    config = config or Config()
    lattice = lattice or Lattice((10.3157, 123.8854), config.grid["edge_km"])
    city = city or load_city(spark, config)
    cells, downtowns, grid = build_features(city, config, lattice, progress)
    cells = run_model(cells, downtowns, config, weights)
    if places is None:
        places = cells.select("city").distinct().withColumn("place", F.lit(config.city["place"]))
    if reference is not None:
        areas = economics.attach(places, reference, aliases=config.economics["place_aliases"])
    else:
        areas = places.withColumn("economics_status", F.lit("unmatched"))
        for c in economics.AREA_COLUMNS:
            areas = areas.withColumn(c, F.lit(None).cast("double"))
        areas = economics.with_per_capita(areas)
    from ..functions.text import area_key

    keep_columns = ["city", "place", "economics_status", *economics.AREA_COLUMNS, "bank_deposits_per_capita_php", "local_tax_revenue_per_capita_php"]
    areas = areas.select(*keep_columns).withColumn("city_key", area_key(F.col("place")))
    cells = cells.join(F.broadcast(areas), "city", "left")
    if observations is None:
        cells = pricing.empty_prices(cells).withColumn("price_source", F.lit(None).cast("string")).withColumn("price_interval", F.lit(None).cast("string"))
    else:
        model = config.price_model
        anchor, seen = pricing.anchors(observations, model), pricing.calibrations(observations)
        size = cells.groupBy("city_key").agg(F.count("*").alias("n_land_cells"), F.max("bank_deposits_php").alias("bank_deposits_php"))
        donor = pricing.donors(anchor, size.select("city_key", "bank_deposits_php"), size.select("city_key", "n_land_cells"))
        target = size.withColumn("deposits_per_cell", F.col("bank_deposits_php") / F.col("n_land_cells"))
        cells = pricing.price_cells(cells, anchor, seen, pricing.comparable(target, donor, model), model)
    cells = keep(cells)
    metadata = cells.groupBy("city").agg(F.count("*").alias("n_land_cells"), F.first("data_source").alias("data_source"), F.first("economics_status").alias("economics_status"), F.count("land_price_php_sqm").alias("priced_cell_count"))
    metadata = metadata.join(grid.groupBy("city").agg(F.count("*").alias("n_grid_cells")), "city").join(downtowns.select("city", F.col("lat").alias("cbd_lat"), F.col("lng").alias("cbd_lng")), "city")
    progress(1.0, "done")
    return Result(cells, downtowns, grid, metadata.withColumn("source_error", F.lit(city.source_error)))
