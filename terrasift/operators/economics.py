"""Area-level economics: building the reference table and attaching it to areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import relational

AREA_COLUMNS = ("city_population", "bank_deposits_php", "bank_accounts", "bank_offices", "local_tax_revenue_php", "real_property_tax_php", "business_tax_php")
FISCAL_COLUMNS = ("local_tax_revenue_php", "real_property_tax_php", "business_tax_php", "fiscal_year", "fiscal_source")
BANK_SOURCE = "PDIC/BSP via ph-bank-deposits"


def per_capita(amount: str, population: str = "city_population"):
    """The amount for each inhabitant; null where there are none."""
    return F.try_divide(F.col(amount), F.nullif(F.col(population), F.lit(0.0)))


def with_per_capita(df: DataFrame) -> DataFrame:
    return df.withColumn("bank_deposits_per_capita_php", per_capita("bank_deposits_php")).withColumn("local_tax_revenue_per_capita_php", per_capita("local_tax_revenue_php"))


def city_rows(summary: DataFrame) -> DataFrame:
    """The latest row of each key of (key, area, province, period, deposits_b)."""
    now = relational.latest(summary, ["key"], "period", "area")
    return now.select(
        F.col("area").alias("core_city"), "province", F.lit("city").alias("deposit_scope"), F.col("area").alias("deposit_area"), "period",
        (F.col("deposits_b") * 1e9).alias("bank_deposits_php"), F.lit(None).cast("double").alias("bank_accounts"), F.lit(None).cast("double").alias("bank_offices"), F.lit(BANK_SOURCE).alias("bank_source"),
    )


def metro_rows(summary: DataFrame, core_of: DataFrame) -> DataFrame:
    """The latest row of each metro of (metro, period, deposits_b, accounts, offices) that
    core_of (core_city, metro) names a core city for."""
    now = relational.latest(summary, ["metro"], "period", "deposits_b")
    return core_of.join(now, "metro").select(
        F.initcap("core_city").alias("core_city"), F.lit(None).cast("string").alias("province"), F.lit("metro").alias("deposit_scope"), F.col("metro").alias("deposit_area"), "period",
        (F.col("deposits_b") * 1e9).alias("bank_deposits_php"), F.col("accounts").cast("double").alias("bank_accounts"), F.col("offices").cast("double").alias("bank_offices"), F.lit(BANK_SOURCE).alias("bank_source"),
    )


def reference_table(cities: DataFrame, metros: DataFrame, population: DataFrame, fiscal: DataFrame | None = None) -> DataFrame:
    """Metro rows, and city rows of areas without one, with population and the latest
    fiscal row by area; ordered by area and scope."""
    keyed = lambda df: df.withColumn("area_key", text.area_key(F.col("core_city")))
    rows = relational.prefer(keyed(metros), keyed(cities), "area_key")
    people = keyed(population).select("area_key", F.col("population").cast("double").alias("city_population"), "population_year", F.col("source_url").alias("population_source"))
    rows = relational.join_unique(rows, people, "area_key", F.col("population_year").desc_nulls_last(), F.col("city_population").desc())
    if fiscal is None:
        for c in FISCAL_COLUMNS:
            rows = rows.withColumn(c, F.lit(None).cast("string" if c == "fiscal_source" else "int" if c == "fiscal_year" else "double"))
    else:
        missing = sorted({"core_city", "local_tax_revenue_php"} - set(fiscal.columns))
        if missing:
            raise ValueError(f"fiscal table: missing columns: {missing}")
        for c in set(FISCAL_COLUMNS) - set(fiscal.columns):
            fiscal = fiscal.withColumn(c, F.lit(None).cast("string" if c == "fiscal_source" else "int" if c == "fiscal_year" else "double"))
        rows = relational.join_unique(rows, keyed(fiscal).select("area_key", *FISCAL_COLUMNS), "area_key", F.col("fiscal_year").desc_nulls_last(), F.col("local_tax_revenue_php").desc())
    return rows.orderBy("area_key", "deposit_scope").drop("area_key")


def with_keys(reference: DataFrame) -> DataFrame:
    """A reference table ready to match: area_key, deposit_scope and a number for ties."""
    if "core_city" not in reference.columns:
        raise ValueError("economic reference: missing columns: ['core_city']")
    for c, kind in (("deposit_scope", "string"), ("province", "string"), ("period", "string"), *((c, "double") for c in AREA_COLUMNS)):
        if c not in reference.columns:
            reference = reference.withColumn(c, F.lit("city" if c == "deposit_scope" else None).cast(kind))
    return reference.withColumn("area_key", text.area_key(F.col("core_city"))).withColumn("ref_id", F.xxhash64(*reference.columns))


def attach(areas: DataFrame, reference: DataFrame, id_col: str = "city", place: str = "place", aliases: dict[str, str] | None = None) -> DataFrame:
    """areas (one row per id, with its place) with the columns of the best matching
    reference row, economics_status and per-capita figures."""
    key = text.area_key(F.col(place))
    for a, b in (aliases or {}).items():
        key = F.when(key == a, text.area_key(F.lit(b))).otherwise(key)
    found = relational.best_match(areas.withColumn("area_key", key), with_keys(reference), "area_key", place, id_col)
    found = found.withColumn("economics_status", F.when(F.col("ref_id").isNull(), "unmatched").otherwise("matched")).drop("ref_id")
    for c in AREA_COLUMNS:
        found = found.withColumn(c, text.finite(F.col(c)))
    return with_per_capita(found)
