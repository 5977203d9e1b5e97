"""Readers of labels, references, layers and caches, and a synthetic city.

Nothing here opens a network connection: map data come as files, through a fetch
function that a caller may supply.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import geo, text
from ..functions.hexgrid import Lattice

REFERENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("core_city", "province", "deposit_scope", "deposit_area", "period", "bank_source", "population_source", "fiscal_source")]
    + [T.StructField(n, T.DoubleType()) for n in ("bank_deposits_php", "bank_accounts", "bank_offices", "city_population", "local_tax_revenue_php", "real_property_tax_php", "business_tax_php")]
    + [T.StructField(n, T.IntegerType()) for n in ("population_year", "fiscal_year")]
)
POPULATION = T.StructType([T.StructField("core_city", T.StringType()), T.StructField("psgc_code", T.StringType()), T.StructField("population", T.LongType()), T.StructField("population_year", T.IntegerType()), T.StructField("source_url", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header; without a schema every column is text, so no file is read twice
    and codes keep their zeros."""
    df = spark.read.option("header", True).option("multiLine", False).csv(path)
    if schema is None:
        return df
    from ..operators import relational

    return relational.conform(df, schema)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or (.jsonl) one object a line."""
    lines = path.lower().endswith(".jsonl")
    return spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path)


def read_geojson(spark: SparkSession, path: str, points: bool = False) -> DataFrame:
    """The properties of a FeatureCollection, as text; with points also lng and lat."""
    raw = spark.read.option("wholetext", True).text(path)
    kind = "struct<features: array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>>"
    each = raw.select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    keys = sorted(r[0] for r in each.select(F.explode(F.map_keys("f.properties"))).distinct().collect())  # names of properties
    at = F.from_json(F.col("f.geometry.coordinates"), "array<double>")
    place = [at[0].alias("lng"), at[1].alias("lat")] if points else []
    rows = each.where(F.col("f.geometry.type") == "Point") if points else each
    return rows.select(*(F.try_element_at(F.col("f.properties"), F.lit(k)).alias(k) for k in keys), *place)


def read_table(spark: SparkSession, path: str, points: bool = False) -> DataFrame:
    """By suffix: .csv, .json, .jsonl, .geojson, else parquet."""
    end = path.lower().rsplit(".", 1)[-1]
    if end == "geojson":
        return read_geojson(spark, path, points)
    return {"csv": read_csv, "json": read_json, "jsonl": read_json}.get(end, lambda s, p: s.read.parquet(p))(spark, path)


def spatial_labels(labels: DataFrame) -> DataFrame:
    """Labels of commercial land: place, property type and price are needed; other kinds go."""
    missing = sorted({"place", "property_type", "price_per_sqm_php", "lng", "lat"} - set(labels.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kind = F.lower(F.coalesce("property_type", F.lit("")))
    return labels.where(kind.contains("commercial") & kind.rlike("land|lot") & ~kind.rlike("house|condo|building|improvement")).withColumn("price_per_sqm_php", text.number(F.col("price_per_sqm_php")))


def cached_cells(spark: SparkSession, root: str, config: Config) -> tuple[int, str] | None:
    """(number of land cells, path) of a city's cached features: by map id, then by name,
    then any with that name; synthetic ones do not count, nor empty ones. Only one
    column is read."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    tail = f"_features_res{config.grid['resolution']}_{config.city['study_buffer_km']:g}km.parquet"
    found = [str(s.getPath()) for s in (fs.globStatus(fs_path(f"{root}/{config.slug}*{tail}")) or [])]
    wanted = [config.cache_slug, config.slug]
    rank = lambda p: next((i for i, w in enumerate(wanted) if p.endswith(f"/{w}{tail}")), len(wanted))
    for p in sorted((p for p in found if "_synth" not in p), key=lambda p: (rank(p), p)):
        n = spark.read.parquet(p).select("cell").count()
        if n:
            return n, p
    return None


def first_working(sources: Iterable[tuple[str, Callable[[], Any]]]) -> Any:
    """The first source's result that is no error; all errors together where none works."""
    errors = []
    for name, fetch in sources:
        try:
            return fetch()
        except Exception as e:  # whatever a source raises, the next one may work
            errors.append(f"{name}: {type(e).__name__}: {e}")
    raise ConnectionError("all sources failed: " + " | ".join(errors))


def is_city_boundary(df: DataFrame) -> Column:
    """Administrative boundaries, and points of cities and towns; no schools or malls."""
    area = (F.col("class") == "boundary") & (F.col("type") == "administrative")
    spot = (F.col("geometry_type") == "Point") & F.col("class").isin("boundary", "place") & F.col("type").isin("administrative", "city", "town")
    return F.coalesce(area | spot, F.lit(False))


def pois_of(features: DataFrame, config: Config) -> DataFrame:
    """(city, category, weight, lng, lat): a row for each category that a feature's tags match.
    features: city, lng, lat, tags map<string,array<string>>."""
    each = [F.when(text.matches_tags(F.col("tags"), spec["tags"]), F.struct(F.lit(name).alias("category"), F.lit(float(spec["weight"])).alias("weight"))) for name, spec in config.poi_categories.items()]
    found = features.where("lng is not null and lat is not null").withColumn("m", F.explode(F.filter(F.array(*each), lambda m: m.isNotNull())))
    return found.select("city", "m.category", "m.weight", "lng", "lat")


def roads_of(ways: DataFrame, config: Config) -> DataFrame:
    """(city, road_id, highway, is_major, line): ways by their first tag."""
    kind = text.first_tag(F.col("highway"))
    return ways.select("city", "road_id", kind.alias("highway"), F.coalesce(kind.isin(config.roads["major_classes"]), F.lit(False)).alias("is_major"), "line")


def water_of(shapes: DataFrame) -> DataFrame:
    """(city, kind, rings): polygons only."""
    return shapes.where(F.col("geometry_type").isin("Polygon", "MultiPolygon")).select("city", "kind", "rings")


def buffered(cells: DataFrame, regions: DataFrame, km: float, lattice: Lattice) -> DataFrame:
    """The cells whose centre lies in their city's region or within km of it."""
    met = cells.join(regions.select("city", "rings"), "city")
    far = F.array_min(F.transform("rings", lambda r: geo.ring_distance(lattice.x(F.col("cell")), lattice.y(F.col("cell")), r)))
    return met.where(far <= km).drop("rings")


def valid_cache(cells: DataFrame, source: str, study: DataFrame) -> bool:
    """Whether cached cells come from that source and lie in the study region."""
    other = cells.where(F.coalesce(F.col("data_source") != source, F.lit(True))).isEmpty()
    met = cells.join(study, "city").where(geo.in_rings(F.col("x"), F.col("y"), F.col("rings")))
    return other and not met.isEmpty()


@dataclass(frozen=True)
class City:
    """Tables of one or many cities: region and water (city, rings), pois, roads, boundary."""

    region: DataFrame
    boundary: DataFrame
    pois: DataFrame
    roads: DataFrame
    water: DataFrame
    source: str = "osm"
    source_error: str | None = None


def _circle(x: float, y: float, r: float, n: int = 48) -> list[tuple[float, float]]:
    return [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]


def synthetic_city(spark: SparkSession, config: Config, n_cities: int = 1, seed: int = 7, origin: tuple[float, float] = (10.3157, 123.8854)) -> City:
    """Radial cities on the plane: eight arterials, two ring roads, 120 short streets, a
    bay, and establishments around a core and four centres. Random numbers are hashes
    of the row's numbers, so any number of cities is generated in parallel and each
    run gives the same ones."""

    def uniform(*keys: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def normal(*keys: Column) -> Column:
        u = F.greatest(uniform(*keys, F.lit("u")), F.lit(1e-9))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(*keys, F.lit("v")))

    cities = spark.range(n_cities).select(F.col("id").cast("int").alias("city"))
    shape = lambda *rings: F.array(*(geo.literal_ring(r) for r in rings))
    region = cities.select("city", shape(_circle(0, 0, 8)).alias("rings"))
    boundary = cities.select("city", shape(_circle(0, 0, 4.8)).alias("rings"))
    water = cities.select("city", F.lit("bay").alias("kind"), shape(_circle(4, -4, 3)).alias("rings"))

    lines = [([(0.0, 0.0), (8 * math.cos(math.pi * k / 4), 8 * math.sin(math.pi * k / 4))], True) for k in range(8)]
    lines += [([*_circle(0, 0, r), _circle(0, 0, r)[0]], r == 5.0) for r in (2.5, 5.0)]
    fixed = F.array(*(F.struct(F.lit(i).cast("long").alias("road_id"), F.lit("primary" if m else "residential").alias("highway"), geo.literal_ring(p).alias("line")) for i, (p, m) in enumerate(lines)))
    main = cities.select("city", F.explode(fixed).alias("r")).select("city", "r.*")
    street = cities.crossJoin(F.broadcast(spark.range(100, 220).select(F.col("id").alias("road_id"))))
    k = (F.col("city"), F.col("road_id"))
    angle, far = 2 * math.pi * uniform(*k, F.lit("a")), 0.3 + 7.7 * uniform(*k, F.lit("r"))
    x, y = far * F.cos(angle), far * F.sin(angle)
    dot = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    streets = street.select("city", "road_id", F.lit("residential").alias("highway"), F.array(dot(x, y), dot(x + 0.6 * normal(*k, F.lit("x")), y + 0.6 * normal(*k, F.lit("y")))).alias("line"))
    roads = main.unionByName(streets).withColumn("is_major", F.col("highway").isin(config.roads["major_classes"]))

    kinds = spark.createDataFrame([(i, c, float(s["weight"])) for i, (c, s) in enumerate(config.poi_categories.items())], "k int, category string, weight double")
    each = cities.crossJoin(F.broadcast(kinds)).withColumn("i", F.explode(F.sequence(F.lit(0), (19 + 40 * uniform(F.col("city"), F.col("k"))).cast("int"))))
    p = (F.col("city"), F.col("k"), F.col("i"))
    centre = F.floor(5 * uniform(*p, F.lit("c"))).cast("int")
    at = lambda axis: F.when(centre > 0, 3.5 * normal(F.col("city"), centre, F.lit(axis))).otherwise(0.0) + F.when(centre > 0, 0.8).otherwise(1.5) * normal(*p, F.lit(axis))
    pois = each.withColumn("x", at("x")).withColumn("y", at("y"))
    pois = pois.where((geo.distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0)) < 8) & (geo.distance(F.col("x"), F.col("y"), F.lit(4.0), F.lit(-4.0)) > 3))
    pois = pois.select("city", "category", "weight", "x", "y", geo.lng_of(F.col("x"), origin).alias("lng"), geo.lat_of(F.col("y"), origin).alias("lat"))
    return City(region, boundary, pois, roads, water, source="synthetic")


def load_city(spark: SparkSession, config: Config, fetch: Callable[[], City] | None = None, strict: bool = False, force_synthetic: bool = False) -> City:
    """What fetch gives; where it fails, a synthetic city with the reason, unless strict."""
    if force_synthetic or fetch is None and not strict:
        return synthetic_city(spark, config)
    try:
        if fetch is None:
            raise LookupError("no source of map data")
        return fetch()
    except Exception as e:
        if strict:
            raise
        found = synthetic_city(spark, config)
        return City(found.region, found.boundary, found.pois, found.roads, found.water, "synthetic", f"{type(e).__name__}: {e}")
