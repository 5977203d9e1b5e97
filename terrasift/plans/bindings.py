"""The test tables in the roles that the operators need, and the same in SQL.

The tables hold no coordinates, so a place follows from a key: customers are cells
or listings, suppliers establishments, nations cities.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.hexgrid import Lattice

ORIGIN = (10.3, 123.9)
LATTICE = Lattice(ORIGIN)
SCALES = {"cbd": 3.0, "major_road": 0.6, "establishment": 1.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(key: Column) -> Column:
    return F.lit(10.2) + ((key * 7919) % 2000) / F.lit(10000.0)


def lng(key: Column) -> Column:
    return F.lit(123.8) + ((key * 104729) % 2000) / F.lit(10000.0)


def placed(df: DataFrame, key: str, city: str | None) -> DataFrame:
    """df with city, lat, lng, x and y."""
    df = df.withColumn("city", F.lit(0) if city is None else F.col(city)).withColumn("lat", lat(F.col(key))).withColumn("lng", lng(F.col(key)))
    return df.withColumn("x", geo.east_km(F.col("lng"), ORIGIN)).withColumn("y", geo.north_km(F.col("lat"), ORIGIN))


_KX = repr(geo.EARTH_KM * math.cos(math.radians(ORIGIN[0])) * math.pi / 180)
_KY = repr(geo.EARTH_KM * math.pi / 180)


def placed_sql(source: str, key: str, city: str = "0") -> str:
    """SELECT of source's columns with city, lat, lng, x and y."""
    return f"""(SELECT *, (lng - {ORIGIN[1]}::DOUBLE) * {_KX}::DOUBLE AS x, (lat - {ORIGIN[0]}::DOUBLE) * {_KY}::DOUBLE AS y FROM (
      SELECT *, {city} AS city, 10.2::DOUBLE + (({key} * 7919) % 2000) / 10000::DOUBLE AS lat, 123.8::DOUBLE + (({key} * 104729) % 2000) / 10000::DOUBLE AS lng FROM {source}))"""


def celled_sql(source: str) -> str:
    """source with cell, q and r of its x and y."""
    e = f"{LATTICE.edge}::DOUBLE"
    return f"""(SELECT * EXCLUDE (fq, fr, a, b, c), ((q + 1048576) * 2097152 + (r + 1048576))::BIGINT AS cell FROM (
      SELECT *, (CASE WHEN abs(a - fq) > abs(b - fr) AND abs(a - fq) > abs(c - (-fq - fr)) THEN -b - c ELSE a END)::BIGINT AS q,
        (CASE WHEN abs(a - fq) > abs(b - fr) AND abs(a - fq) > abs(c - (-fq - fr)) THEN b WHEN abs(b - fr) > abs(c - (-fq - fr)) THEN -a - c ELSE b END)::BIGINT AS r
      FROM (SELECT *, floor(fq + 0.5::DOUBLE) AS a, floor(fr + 0.5::DOUBLE) AS b, floor((-fq - fr) + 0.5::DOUBLE) AS c FROM (
        SELECT *, ({math.sqrt(3) / 3!r}::DOUBLE * x - y / 3) / {e} AS fq, (y * 2 / 3) / {e} AS fr FROM {source}))))"""


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    return f"{2 * geo.EARTH_KM!r}::DOUBLE * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))"


def area_key_sql(name: str) -> str:
    """The same key as text.area_key."""
    x = f"split_part(lower(strip_accents(coalesce({name}, ''))), ',', 1)"
    for pattern, put in (("\\([^)]*\\)", " "), ("^city\\s+of\\s+", ""), ("\\bcity\\b", " "), ("\\bsto\\.?\\b", "santo"), ("\\bsta\\.?\\b", "santa"), ("[^a-z0-9]+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return f"trim({x})"


def rank_sql(value: str, by: str, positive: bool = False) -> str:
    """Average rank over the number of values, in a SELECT over one row per value holder."""
    part = f"PARTITION BY {by}, ({value}) > 0" if positive else f"PARTITION BY {by}, ({value}) IS NULL"
    rank = f"(rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({part}, {value}) - 1) / 2.0::DOUBLE) / count(*) OVER ({part})"
    return f"CASE WHEN {value} > 0 THEN {rank} ELSE 0.0::DOUBLE END" if positive else f"CASE WHEN {value} IS NULL THEN NULL ELSE {rank} END"


def min_max_sql(value: str, by: str) -> str:
    over = f"OVER (PARTITION BY {by})"
    return f"CASE WHEN max({value}) {over} - min({value}) {over} < 1e-12 THEN 0.0::DOUBLE ELSE ({value} - min({value}) {over}) / (max({value}) {over} - min({value}) {over}) END"
