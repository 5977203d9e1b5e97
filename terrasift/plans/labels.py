"""Queries on price labels, economics and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text
from ..operators import economics, pricing, stats
from ..sources import readers
from ..storage import keep
from .bindings import area_key_sql, table

QUERIES, ORACLES = {}, {}
MODEL = DEFAULTS["price_model"]
KINDS = ["Commercial Lot", "commercial land - vacant", "House and Lot", "Commercial Building", "Residential land", None]


def raw_listings(spark, d):
    """Line items as listings, every field written as a listing site would."""
    df = table(spark, d, "lineitem")
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (F.col("l_partkey") % 6 + 1).cast("int"))
    return df.select(
        F.when(F.col("l_linenumber") < 6, F.concat(F.lit("L"), (F.col("l_orderkey") % 5000).cast("string"))).alias("listing_id"),
        F.when(F.col("l_suppkey") % 17 != 0, F.concat(F.lit("site "), (F.col("l_suppkey") % 3).cast("string"))).alias("source"),
        F.concat(F.when(F.col("l_partkey") % 13 == 0, "ftp://x/").otherwise("https://x/"), (F.col("l_partkey") % 400).cast("string")).alias("URL"),
        F.when(F.col("l_quantity") > 3, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("soon").alias("observed_at"),
        F.concat(F.lit("City of C"), (F.col("l_suppkey") % 25).cast("string"), F.lit(", P")).alias("city"),
        kind.alias("property_type"),
        F.concat(F.lit("PHP "), F.floor("l_extendedprice").cast("string")).alias("price"),
        F.concat(F.floor("l_quantity").cast("string"), F.lit(" sqm")).alias("lot_area"),
        (4 + F.col("l_partkey") % 20).cast("double").alias("lat"),
        F.lit(120.5).alias("lng"),
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("_seq"),
    )


def listing_normalization(spark, d):
    found = pricing.normalize_listings(raw_listings(spark, d), MODEL)
    return found.select(F.col("_seq").alias("seq"), "listing_id", "city_group", "property_type", F.round("price_per_sqm_php", 4).alias("price_per_sqm_php"), "latitude")


QUERIES["listing_normalization"] = listing_normalization
_CHECKED = f"""
WITH raw AS (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS seq, CASE WHEN l_linenumber < 6 THEN 'L' || (l_orderkey % 5000) END AS listing_id, CASE WHEN l_suppkey % 17 <> 0 THEN 'site ' || (l_suppkey % 3) END AS source,
    (CASE WHEN l_partkey % 13 = 0 THEN 'ftp://x/' ELSE 'https://x/' END) || (l_partkey % 400) AS source_url, CASE WHEN l_quantity > 3 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE 'soon' END AS observed_at,
    'City of C' || (l_suppkey % 25) || ', P' AS city, CASE l_partkey % 6 {' '.join(f"WHEN {i} THEN {'NULL' if k is None else repr(k)}" for i, k in enumerate(KINDS))} END AS kind,
    'PHP ' || floor(l_extendedprice)::BIGINT AS price, floor(l_quantity)::BIGINT || ' sqm' AS area, (4 + l_partkey % 20)::DOUBLE AS latitude FROM lineitem),
typed AS (SELECT *, array_to_string(regexp_extract_all(lower(coalesce(kind, '')), '[a-z0-9]+'), '_') AS property_type,
    try_cast(nullif(regexp_replace(price, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) / nullif(try_cast(nullif(regexp_replace(area, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE), 0) AS p FROM raw),
checked AS (SELECT *, contains(property_type, 'commercial') AND (contains(property_type, 'land') OR contains(property_type, 'lot')) AND NOT regexp_matches(property_type, 'house|condo|townhouse|building|improvement') AS ok_type,
    coalesce(p BETWEEN 250 AND 1000000, false) AS ok_price, latitude BETWEEN 4 AND 22 AS ok_location,
    coalesce(trim(source), '') <> '' AND regexp_matches(source_url, '^https?://') AND try_cast(observed_at AS TIMESTAMP) IS NOT NULL AS ok_provenance FROM typed)
"""
ORACLES["listing_normalization"] = (
    _CHECKED
    + f"""
, good AS (SELECT * FROM checked WHERE ok_type AND ok_price AND ok_location AND ok_provenance),
once AS (SELECT * FROM good WHERE listing_id IS NULL UNION ALL (SELECT * FROM good WHERE listing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, listing_id ORDER BY seq) = 1)),
last AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY source_url, latitude, p ORDER BY seq DESC) = 1)
SELECT seq, listing_id, {area_key_sql('city')} AS city_group, property_type, round(p, 4) AS price_per_sqm_php, latitude FROM last"""
)


def reject_reason_counts(spark, d):
    return pricing.reject_counts(pricing.checked_listings(raw_listings(spark, d), MODEL))


QUERIES["reject_reason_counts"] = reject_reason_counts
ORACLES["reject_reason_counts"] = _CHECKED + """SELECT count(*) AS input_rows, count(*) FILTER (ok_type AND ok_price AND ok_location AND ok_provenance) AS accepted_rows, count(*) FILTER (NOT ok_type) AS rejected_type,
count(*) FILTER (NOT ok_price) AS rejected_price, count(*) FILTER (NOT ok_location) AS rejected_location, count(*) FILTER (NOT ok_provenance) AS rejected_provenance FROM checked"""


def spatial_labels(spark, d):
    """Line items as spatial labels: those of commercial land, with the number in their price."""
    found = readers.spatial_labels(raw_listings(spark, d).withColumnRenamed("city", "place").withColumnRenamed("price", "price_per_sqm_php"))
    return found.select(F.col("_seq").alias("seq"), "place", "price_per_sqm_php")


QUERIES["spatial_labels"] = spatial_labels
ORACLES["spatial_labels"] = _CHECKED + """SELECT seq, city AS place, try_cast(regexp_replace(price, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS price_per_sqm_php FROM checked
WHERE contains(lower(kind), 'commercial') AND regexp_matches(lower(kind), 'land|lot') AND NOT regexp_matches(lower(kind), 'house|condo|building|improvement')"""


def observations(spark, d):
    """Orders as market observations of their customer's nation."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(
        (F.col("o_orderkey") % 9000).cast("string").alias("market_id"), F.concat(F.lit("City of "), F.initcap("n_name")).alias("city"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("province"), F.col("c_mktsegment").alias("market_area"),
        F.when(F.col("o_orderkey") % 7 == 0, "Residential lot").otherwise("Commercial lot").alias("property_type"), F.lit("site").alias("source"), F.lit("https://x").alias("source_url"), F.lit(None).cast("string").alias("notes"),
        F.col("o_totalprice").alias("price_per_sqm_php"), (F.col("o_orderkey") % 4).cast("double").alias("underlying_listings"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("observed_at"), F.col("o_orderkey").alias("_seq"),
    )


def market_normalization(spark, d):
    found = pricing.normalize_observations(observations(spark, d), MODEL)
    return found.select("market_id", "market_group", "price_per_sqm_php", "underlying_listings", F.col("_seq").alias("seq"))


QUERIES["market_normalization"] = market_normalization
_OBS = f"""obs AS (SELECT (o_orderkey % 9000)::VARCHAR AS market_id, {area_key_sql("'City of ' || n_name")} AS city_key, {area_key_sql("'R' || n_regionkey")} AS province_key, n_nationkey, o_totalprice AS price,
  greatest(1.0::DOUBLE, (o_orderkey % 4)::DOUBLE) AS listings, o_orderkey AS seq, c_mktsegment AS market_area FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderkey % 7 <> 0 AND o_totalprice BETWEEN 250 AND 1000000 QUALIFY row_number() OVER (PARTITION BY o_orderkey % 9000 ORDER BY o_orderkey DESC) = 1)"""
ORACLES["market_normalization"] = f"WITH {_OBS} SELECT market_id, city_key || '|' || province_key AS market_group, price AS price_per_sqm_php, listings AS underlying_listings, seq FROM obs"


def weighted_median_anchor(spark, d):
    found = pricing.anchors(pricing.normalize_observations(observations(spark, d), MODEL), MODEL)
    return found.select("city_key", F.round("anchor_price", 4).alias("anchor_price"), F.round("half_width", 6).alias("half_width"), "n_observations", F.col("n_listings").cast("double").alias("n_listings"))


QUERIES["weighted_median_anchor"] = weighted_median_anchor


def _quantile_sql(source: str, value: str, weight: str, by: str, out: str) -> str:
    return f"""(SELECT {by}, min(v) FILTER (so_far >= total * 0.5::DOUBLE) AS {out} FROM (SELECT {by}, v, sum(w) OVER (PARTITION BY {by} ORDER BY v ROWS UNBOUNDED PRECEDING) AS so_far, sum(w) OVER (PARTITION BY {by}) AS total
      FROM (SELECT {by}, {value} AS v, sum({weight}) AS w FROM {source} GROUP BY 1, 2)) GROUP BY {by})"""


_ANCHORS = f"""{_OBS}, lp AS (SELECT *, ln(price) AS v0, sqrt(listings) AS w0 FROM obs), n AS (SELECT city_key, count(*) AS n, sum(listings) AS nl FROM obs GROUP BY 1 HAVING count(*) >= 3),
mid AS {_quantile_sql('lp', 'v0', 'w0', 'city_key', 'm')}, off AS (SELECT lp.*, abs(v0 - m) AS o FROM lp JOIN mid USING (city_key)), mad AS {_quantile_sql('off', 'o', 'w0', 'city_key', 'd')},
anchors AS (SELECT city_key, exp(m) AS anchor_price, least(greatest(1.2816 * 1.4826 * d / sqrt(n), 0.12), 0.35)::DOUBLE AS half_width, n, nl FROM n JOIN mid USING (city_key) JOIN mad USING (city_key))"""
ORACLES["weighted_median_anchor"] = f"WITH {_ANCHORS} SELECT city_key, round(anchor_price, 4) AS anchor_price, round(half_width, 6) AS half_width, n AS n_observations, nl AS n_listings FROM anchors"


def anchor_labels(spark, d):
    found = pricing.anchor_labels(pricing.normalize_observations(observations(spark, d), MODEL))
    return found.select("city_key", "city", "province", F.array_join("market_areas", ",").alias("market_areas"))


QUERIES["anchor_labels"] = anchor_labels
ORACLES["anchor_labels"] = f"""WITH {_OBS} SELECT city_key, arg_min(city, seq) AS city, arg_min(province, seq) AS province, string_agg(DISTINCT market_area, ',' ORDER BY market_area) AS market_areas
FROM (SELECT obs.*, 'City of ' || list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS city, 'R' || n_regionkey AS province FROM obs JOIN nation USING (n_nationkey)) GROUP BY 1"""


def weighted_mean_calibration(spark, d):
    found = pricing.calibrations(pricing.normalize_observations(observations(spark, d), MODEL))
    return found.select("city_key", F.round("price", 4).alias("price"), "n_observations", "n_listings")


QUERIES["weighted_mean_calibration"] = weighted_mean_calibration
ORACLES["weighted_mean_calibration"] = f"WITH {_OBS} SELECT city_key, round(sum(price * listings) / sum(listings), 4) AS price, count(*) AS n_observations, sum(listings) AS n_listings FROM obs GROUP BY 1"


def nations(spark, d):
    """Nations as areas: customers are inhabitants and land cells, balances deposits."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("deposits"))
    n = table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"))
    return n.select("n_nationkey", text.area_key(F.concat(F.lit("City of "), F.initcap("n_name"))).alias("city_key"), F.col("deposits").alias("bank_deposits_php"), F.col("n").alias("n_land_cells"))


_NATIONS = f"(SELECT n_nationkey, {area_key_sql('n_name')} AS city_key, sum(greatest(c_acctbal, 0)) AS deposits, count(*) AS cells, sum(greatest(c_acctbal, 0)) / count(*) AS density FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2)"


def donor_profiles(spark, d, anchor=None):
    if anchor is None:
        anchor = pricing.anchors(pricing.normalize_observations(observations(spark, d), MODEL), MODEL)
    return pricing.donors(anchor, nations(spark, d).where("n_nationkey % 2 = 0").drop("n_land_cells"), nations(spark, d).select("city_key", "n_land_cells"))


def donor_city_profiles(spark, d):
    return donor_profiles(spark, d).select("city_key", F.round("anchor_price", 4).alias("anchor_price"), F.round("deposits_per_cell", 4).alias("deposits_per_cell"), "n_land_cells")


QUERIES["donor_city_profiles"] = donor_city_profiles
ORACLES["donor_city_profiles"] = f"WITH {_ANCHORS} SELECT city_key, round(anchor_price, 4) AS anchor_price, round(density, 4) AS deposits_per_cell, cells AS n_land_cells FROM anchors JOIN {_NATIONS} USING (city_key) WHERE n_nationkey % 2 = 0 AND deposits > 0"


def compared(spark, d, anchor=None):
    targets = nations(spark, d).where("n_nationkey % 2 = 1").withColumn("deposits_per_cell", F.col("bank_deposits_php") / F.col("n_land_cells"))
    return pricing.comparable(targets, donor_profiles(spark, d, anchor), MODEL)


def comparable_city_baseline(spark, d):
    return compared(spark, d).select("city_key", F.round("price", 3).alias("price"), F.round("half_width", 6).alias("half_width"), "n_donors")


QUERIES["comparable_city_baseline"] = comparable_city_baseline
_COMPARED = f"""donors AS (SELECT a.city_key AS donor, a.anchor_price, a.half_width, n.density AS dd FROM anchors a JOIN {_NATIONS} n USING (city_key) WHERE n.n_nationkey % 2 = 0 AND deposits > 0),
pairs AS (SELECT t.city_key, d.*, t.density / dd AS ratio, abs(ln(t.density / dd)) AS dist FROM {_NATIONS} t CROSS JOIN donors d WHERE t.n_nationkey % 2 = 1 AND t.density > 0 QUALIFY row_number() OVER (PARTITION BY t.city_key ORDER BY dist, donor) <= 3),
w AS (SELECT *, anchor_price * least(greatest(ratio, 0.01), 100.0) AS scaled, greatest(exp(-0.5::DOUBLE * pow(dist / 0.75::DOUBLE, 2)), 1e-6) AS w FROM pairs),
m AS (SELECT *, sum(ln(scaled) * w) OVER (PARTITION BY city_key) / sum(w) OVER (PARTITION BY city_key) AS ml FROM w),
compared AS (SELECT city_key, sum(scaled * w) / sum(w) AS price, least(greatest(greatest(sum(half_width * w) / sum(w), 1.2816 * sqrt(sum(pow(ln(scaled) - ml, 2) * w) / sum(w))), 0.25), 0.65)::DOUBLE AS half_width, count(*) AS n_donors FROM m GROUP BY 1)"""
ORACLES["comparable_city_baseline"] = f"WITH {_ANCHORS}, {_COMPARED} SELECT city_key, round(price, 3) AS price, round(half_width, 6) AS half_width, n_donors FROM compared"


def priced_cells(spark, d):
    n = nations(spark, d).select("n_nationkey", "city_key")
    c = table(spark, d, "customer").withColumn("land_value_score", (F.greatest("c_acctbal", F.lit(0.0)) + 1) / 10000).withColumn("area_sqm", F.lit(1.0)).withColumn("in_metro", F.col("c_custkey") % 5 != 0)
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))


def price_dispatch(spark, d):
    """Nations that four divides have anchors, other even ones observed means, odd ones comparables."""
    obs = keep(pricing.normalize_observations(observations(spark, d), MODEL))
    anchored = keep(pricing.anchors(obs, MODEL))
    key = nations(spark, d).select("city_key", "n_nationkey")
    anchor = anchored.join(key, "city_key").where("n_nationkey % 4 = 0")
    seen = pricing.calibrations(obs).join(key, "city_key").where("n_nationkey % 4 = 2")
    out = pricing.price_cells(priced_cells(spark, d), anchor, seen, compared(spark, d, anchored), MODEL, -0.2, 0.3)
    return out.select("c_custkey", "price_source", *(F.round(c, 4).alias(c) for c in pricing.PRICES))


QUERIES["price_dispatch"] = price_dispatch
_CELLS = f"(SELECT c_custkey, n.city_key, n.n_nationkey, (greatest(c_acctbal, 0) + 1) / 10000 AS score, c_custkey % 5 <> 0 AS in_metro FROM customer JOIN {_NATIONS} n ON c_nationkey = n_nationkey)"
ORACLES["price_dispatch"] = f"""WITH {_ANCHORS}, {_COMPARED}, seen AS (SELECT city_key, sum(price * listings) / sum(listings) AS price FROM obs GROUP BY 1),
j AS (SELECT c.*, CASE WHEN n_nationkey % 4 = 0 THEN a.anchor_price END AS pa, a.half_width AS ha, CASE WHEN n_nationkey % 4 = 2 THEN s.price END AS ps, k.price AS pk, k.half_width AS hk
  FROM {_CELLS} c LEFT JOIN anchors a USING (city_key) LEFT JOIN seen s USING (city_key) LEFT JOIN compared k USING (city_key)),
src AS (SELECT *, CASE WHEN NOT in_metro THEN NULL WHEN pa IS NOT NULL THEN 'top_market_anchor' WHEN ps IS NOT NULL THEN 'observed_market_calibration' WHEN pk IS NOT NULL THEN 'deposit_per_cell_comparable_cities' END AS price_source FROM j),
surf AS (SELECT *, quantile_cont(score, 0.9) OVER (PARTITION BY city_key, price_source) AS q, avg(score) OVER (PARTITION BY city_key, price_source) AS ms FROM src),
est AS (SELECT *, CASE price_source WHEN 'top_market_anchor' THEN pa * least(greatest(pow(score / q, 0.65::DOUBLE), 0.1), 1.35) WHEN 'observed_market_calibration' THEN ps * score / ms WHEN 'deposit_per_cell_comparable_cities' THEN pk * score / ms END AS p,
  CASE price_source WHEN 'top_market_anchor' THEN -ha WHEN 'deposit_per_cell_comparable_cities' THEN -hk ELSE -0.2 END AS lo, CASE price_source WHEN 'top_market_anchor' THEN ha WHEN 'deposit_per_cell_comparable_cities' THEN hk ELSE 0.3 END AS hi FROM surf)
SELECT c_custkey, price_source, CASE WHEN p IS NULL THEN NULL ELSE round(least(greatest(p, 250), 1000000), 4) END AS land_price_php_sqm, CASE WHEN p IS NULL THEN NULL ELSE round(least(greatest(p * exp(lo), 250), 1000000), 4) END AS land_price_low_php_sqm,
  CASE WHEN p IS NULL THEN NULL ELSE round(least(greatest(p * exp(hi), 250), 1000000), 4) END AS land_price_high_php_sqm, CASE WHEN p IS NULL THEN NULL ELSE round(CASE WHEN price_source = 'top_market_anchor' THEN pa WHEN price_source = 'observed_market_calibration' THEN ps ELSE pk END, 4) END AS land_price_market_baseline_php_sqm FROM est"""


def anchor_price_surface(spark, d):
    cells = priced_cells(spark, d).withColumn("anchor", F.lit(50000.0))
    return pricing.anchor_surface(cells, "anchor", "price", MODEL, ["city_key"]).select("c_custkey", F.round("price", 3).alias("price"))


QUERIES["anchor_price_surface"] = anchor_price_surface
ORACLES["anchor_price_surface"] = f"SELECT c_custkey, round(50000.0::DOUBLE * least(greatest(pow(score / quantile_cont(score, 0.9) OVER (PARTITION BY city_key), 0.65::DOUBLE), 0.1), 1.35), 3) AS price FROM {_CELLS}"


def relative_blend(spark, d):
    cells = priced_cells(spark, d).withColumn("estimate", 20000.0 + F.col("c_custkey") % 100).withColumn("area_sqm", (F.col("c_custkey") % 7 + 1).cast("double"))
    return pricing.blended(cells, "estimate", "price", 0.35, ["city_key"]).select("c_custkey", F.round("price", 3).alias("price"))


QUERIES["relative_blend"] = relative_blend
ORACLES["relative_blend"] = f"""WITH b AS (SELECT *, 20000.0::DOUBLE + c_custkey % 100 AS e, (c_custkey % 7 + 1)::DOUBLE AS a FROM {_CELLS}),
m AS (SELECT *, sum(e * a) OVER w / sum(a) OVER w AS me, sum(score * a) OVER w / sum(a) OVER w AS ms FROM b WINDOW w AS (PARTITION BY city_key)),
k AS (SELECT *, exp(0.65::DOUBLE * ln(e / me) + 0.35::DOUBLE * ln(score / ms)) AS c FROM m)
SELECT c_custkey, round(me * c / (sum(c * a) OVER (PARTITION BY city_key) / sum(a) OVER (PARTITION BY city_key)), 3) AS price FROM k"""


def log_feature_matrix(spark, d):
    df = table(spark, d, "customer").withColumn("bank_deposits_php", F.col("c_acctbal")).withColumn("city_population", F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("double")).when(F.col("c_nationkey") > 1, 0.0)).withColumn("local_tax_revenue_php", F.col("c_acctbal") * 2)
    df = pricing.log_features(economics.with_per_capita(df), ["bank_deposits_php", "bank_deposits_per_capita_php", "city_population"])
    return df.select("c_custkey", F.round("log_bank_deposits_php", 6).alias("log_deposits"), F.round("log_bank_deposits_per_capita_php", 6).alias("log_per_capita"), F.round("log_city_population", 6).alias("log_population"))


QUERIES["log_feature_matrix"] = log_feature_matrix
ORACLES["log_feature_matrix"] = """SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS log_deposits, CASE WHEN c_nationkey > 3 THEN round(ln(1 + greatest(c_acctbal / c_nationkey, 0)), 6) END AS log_per_capita,
CASE WHEN c_nationkey > 3 THEN round(ln(1 + c_nationkey::DOUBLE), 6) WHEN c_nationkey > 1 THEN 0.0::DOUBLE END AS log_population FROM customer"""


def normalize_area_name(spark, d):
    """Keys of customers' and nations' names in the forms that areas are written in."""
    n = table(spark, d, "nation").select(F.explode(F.array(F.concat(F.lit("City of "), "n_name"), F.concat("n_name", F.lit(" City, Region")), F.concat(F.lit("Sto. "), "n_name", F.lit(" (old)")), F.concat(F.lit("Peñablanca-"), "n_name"), F.concat(F.lit("Sta "), "n_name"))).alias("name"))
    c = table(spark, d, "customer").select(F.concat(F.lit("Citadel #"), "c_name").alias("name"))
    return n.union(c).select("name", text.area_key(F.col("name")).alias("area_key"), text.slug(F.col("name")).alias("slug"))


QUERIES["normalize_area_name"] = normalize_area_name
ORACLES["normalize_area_name"] = f"""SELECT name, {area_key_sql('name')} AS area_key, replace(lower(trim(split_part(name, ',', 1))), ' ', '_') AS slug FROM (
SELECT unnest(['City of ' || n_name, n_name || ' City, Region', 'Sto. ' || n_name || ' (old)', 'Peñablanca-' || n_name, 'Sta ' || n_name]) AS name FROM nation UNION ALL SELECT 'Citadel #' || c_name FROM customer)"""


def economic_reference(spark, d):
    """City and metro summaries from orders by quarter, with population and fiscal rows."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.withColumn("period", F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyy-MM-dd"))
    city = o.groupBy(F.col("n_name").alias("key"), F.concat("n_name", F.lit(" City")).alias("area"), F.concat(F.lit("R"), "n_regionkey").alias("province"), "period").agg((F.sum("o_totalprice") / 1e9).alias("deposits_b"))
    metro = o.where("n_nationkey % 3 = 0").groupBy(F.concat(F.lit("Metro "), "n_name").alias("metro"), "period").agg((F.sum("o_totalprice") / 1e8).alias("deposits_b"), F.count("*").alias("accounts"), F.count_distinct("o_custkey").alias("offices"))
    core = table(spark, d, "nation").select(F.lower("n_name").alias("core_city"), F.concat(F.lit("Metro "), "n_name").alias("metro"))
    people = table(spark, d, "customer").groupBy("c_nationkey").count().join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("core_city"), F.col("count").alias("population"), F.lit(2024).alias("population_year"), F.lit("x").alias("source_url"))
    fiscal = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("City of "), "n_name").alias("core_city"), F.col("s_acctbal").alias("local_tax_revenue_php"), (F.col("s_suppkey") + 1000).cast("int").alias("fiscal_year"))
    found = economics.reference_table(economics.city_rows(city), economics.metro_rows(metro, core), people, fiscal)
    return found.select("core_city", "deposit_scope", "period", F.round(F.col("bank_deposits_php") / 1e6, 3).alias("deposits_m"), "bank_accounts", "city_population", "local_tax_revenue_php", "fiscal_year")


QUERIES["economic_reference"] = economic_reference
_TITLE = "list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"
ORACLES["economic_reference"] = f"""WITH o AS (SELECT *, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
city AS (SELECT n_nationkey, n_name || ' City' AS core_city, period, sum(o_totalprice) AS dep FROM o GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY period DESC) = 1),
metro AS (SELECT n_nationkey, {_TITLE} AS core_city, period, sum(o_totalprice) * 10 AS dep, count(*)::DOUBLE AS acc FROM o WHERE n_nationkey % 3 = 0 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY period DESC) = 1),
both_ AS (SELECT n_nationkey, core_city, 'metro' AS deposit_scope, period, dep, acc FROM metro UNION ALL SELECT n_nationkey, core_city, 'city', period, dep, NULL FROM city WHERE n_nationkey NOT IN (SELECT n_nationkey FROM metro)),
fiscal AS (SELECT s_nationkey, s_acctbal, (s_suppkey + 1000)::INT AS y FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) = 1)
SELECT core_city, deposit_scope, period, round(dep / 1e6, 3) AS deposits_m, acc AS bank_accounts, n.c::DOUBLE AS city_population, f.s_acctbal AS local_tax_revenue_php, f.y AS fiscal_year
FROM both_ b LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) n ON n.c_nationkey = b.n_nationkey LEFT JOIN fiscal f ON f.s_nationkey = b.n_nationkey"""


def reference_rows(spark, d):
    """Suppliers as reference rows: metro, city and other scopes, several per name."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    scope = F.element_at(F.array(F.lit("metro"), F.lit("city"), F.lit("barangay")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return s.select(F.col("n_name").alias("core_city"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Prov"), (F.col("s_suppkey") % 4).cast("string"))).alias("province"), scope.alias("deposit_scope"), F.concat((F.col("s_suppkey") % 7 + 2000).cast("string"), F.lit("-01-01")).alias("period"), F.col("s_acctbal").alias("bank_deposits_php"), F.col("s_suppkey").alias("ref_id"))


def best_reference_match(spark, d):
    """The best reference row of every customer."""
    from ..operators import relational

    asked = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = asked.select("c_custkey", F.concat("n_name", F.lit(" City, Prov"), (F.col("c_custkey") % 6).cast("string"), F.lit(", Philippines")).alias("place")).withColumn("area_key", text.area_key(F.col("place")))
    ref = reference_rows(spark, d).withColumn("area_key", text.area_key(F.col("core_city")))
    return relational.best_match(asked, ref, "area_key", "place", "c_custkey").select("c_custkey", F.col("ref_id").alias("s_suppkey"), "deposit_scope", "period")


QUERIES["best_reference_match"] = best_reference_match
ORACLES["best_reference_match"] = """WITH ref AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Prov' || (s_suppkey % 4) END AS province, ['metro', 'city', 'barangay'][s_suppkey % 3 + 1] AS deposit_scope, (s_suppkey % 7 + 2000) || '-01-01' AS period FROM supplier),
j AS (SELECT c_custkey, r.*, coalesce(contains(lower('Prov' || (c_custkey % 6)), lower(province)), false) AS named FROM customer LEFT JOIN ref r ON s_nationkey = c_nationkey),
k AS (SELECT *, bool_or(named) OVER (PARTITION BY c_custkey) AS any_ FROM j)
SELECT c_custkey, s_suppkey, deposit_scope, period FROM k WHERE named OR NOT any_
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE deposit_scope WHEN 'metro' THEN 0 WHEN 'city' THEN 1 ELSE 2 END, period DESC NULLS LAST, s_suppkey NULLS FIRST) = 1"""


def residual_quantiles(spark, d):
    """Errors of each customer's mean price as a prediction for its orders, by nation."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = stats.with_group(o, ["c_nationkey"], guess=F.avg("o_totalprice")).withColumn("rest", F.log("o_totalprice") - F.log("guess"))
    a = o.groupBy("c_nationkey").agg(stats.quantile("rest", 0.1).alias("q10"), stats.quantile("rest", 0.9).alias("q90"), *stats.errors(F.col("o_totalprice"), F.col("guess")))
    return a.select("c_nationkey", *(F.round(c, 5).alias(c) for c in ("q10", "q90", "mae", "median_ae", "median_ape", "r2_log")))


QUERIES["residual_quantiles"] = residual_quantiles
ORACLES["residual_quantiles"] = """WITH o AS (SELECT c_nationkey, o_totalprice AS p, avg(o_totalprice) OVER (PARTITION BY c_nationkey) AS g FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, round(quantile_cont(ln(p) - ln(g), 0.1), 5) AS q10, round(quantile_cont(ln(p) - ln(g), 0.9), 5) AS q90, round(avg(abs(p - g)), 5) AS mae, round(median(abs(p - g)), 5) AS median_ae, round(median(abs(p - g) / p), 5) AS median_ape,
round(1 - sum(pow(ln(p) - ln(g), 2)) / (var_pop(ln(p)) * count(*)), 5) AS r2_log FROM o GROUP BY 1"""
