"""Price labels: cleaning, calibration, comparable cities and the prices of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..storage import keep
from . import relational, stats

#: Headers that stand for a listing's columns.
LISTING_ALIASES = {
    "lat": "latitude", "lng": "longitude", "lon": "longitude",
    "asking_price": "price_php", "advertised_price": "price_php", "selling_price": "price_php", "minimum_bid_price": "price_php", "price": "price_php",
    "land_area": "lot_area_sqm", "lot_area": "lot_area_sqm", "area_sqm": "lot_area_sqm",
    "price_per_sqm": "price_per_sqm_php", "price_sqm": "price_per_sqm_php", "url": "source_url",
}
_S, _D = T.StringType(), T.DoubleType()
LISTINGS = T.StructType(
    [T.StructField(n, _S) for n in ("listing_id", "source", "source_url")]
    + [T.StructField("observed_at", T.TimestampType())]
    + [T.StructField(n, _S) for n in ("city", "province", "property_type")]
    + [T.StructField(n, _D) for n in ("latitude", "longitude", "price_php", "lot_area_sqm", "price_per_sqm_php")]
    + [T.StructField("cell", _S), T.StructField("_seq", T.LongType())]
)
OBSERVATIONS = T.StructType(
    [T.StructField(n, _S) for n in ("market_id", "city", "province", "market_area", "property_type", "source", "source_url", "notes")]
    + [T.StructField("price_per_sqm_php", _D), T.StructField("underlying_listings", _D), T.StructField("observed_at", T.TimestampType()), T.StructField("_seq", T.LongType())]
)
REQUIRED = {"market_id", "city", "province", "property_type", "price_per_sqm_php", "observed_at", "source", "source_url"}


def commercial_land(kind: Column, model: dict) -> Column:
    """On a canonical property type: all required terms, a land term and no improvement."""
    land, required = text.contains_any(kind, model["land_type_terms"]), text.contains_all(kind, model["required_property_type_terms"])
    return land & required & ~text.contains_any(kind, model["improvement_terms"])


def price_ok(price: Column, model: dict) -> Column:
    return F.coalesce(price.between(model["min_price_per_sqm_php"], model["max_price_per_sqm_php"]), F.lit(False))


def provenance_ok(source: Column, url: Column, observed: Column) -> Column:
    return text.filled(source) & F.coalesce(url.rlike("^https?://"), F.lit(False)) & observed.isNotNull()


def location_ok(lat: Column, lng: Column, cell: Column) -> Column:
    return F.coalesce(lat.between(4, 22) & lng.between(116, 127), F.lit(False)) | cell.isNotNull()


def checked_listings(raw: DataFrame, model: dict) -> DataFrame:
    """Listings in canonical columns with the four checks ok_type, ok_price, ok_location
    and ok_provenance. A column _seq gives the rows' order; without one, equal rows
    are ordered by their contents."""
    df = relational.settled(relational.conform(raw.withColumnRenamed("h3", "cell"), LISTINGS, LISTING_ALIASES))
    df = df.withColumn("price_per_sqm_php", text.unit_price(F.col("price_per_sqm_php"), F.col("price_php"), F.col("lot_area_sqm")))
    df = relational.settled(df.withColumn("property_type", text.property_type(F.col("property_type"))))
    return df.withColumns({
        "ok_type": commercial_land(F.col("property_type"), model),
        "ok_price": price_ok(F.col("price_per_sqm_php"), model),
        "ok_location": location_ok(F.col("latitude"), F.col("longitude"), F.col("cell")),
        "ok_provenance": provenance_ok(F.col("source"), F.col("source_url"), F.col("observed_at")),
    })


def reject_counts(checked: DataFrame) -> DataFrame:
    """One row of counts; a row that fails several checks counts in each."""
    checks = [c for c in checked.columns if c.startswith("ok_")]
    good = F.lit(True)
    for c in checks:
        good = good & F.col(c)
    return checked.agg(F.count("*").alias("input_rows"), F.count_if(good).alias("accepted_rows"), *(F.count_if(~F.col(c)).alias(f"rejected_{c[3:]}") for c in checks))


def deduplicated(listings: DataFrame) -> DataFrame:
    """The first row of each source and listing id, then the last of each
    (source_url, latitude, longitude, price)."""
    # Rows of one place in the order, or of none, are told apart by their contents.
    order = F.struct(F.coalesce("_seq", F.lit(0)), F.xxhash64(*listings.columns))
    own = F.when(text.filled(F.col("listing_id")), F.concat_ws("|", F.coalesce("source", F.lit("")), "listing_id"))
    df = listings.withColumn("_order", order)
    df = relational.pick(df.withColumn("_id", F.coalesce(own, F.concat(F.lit("no id "), F.col("_order").cast("string")))), ["_id"], F.col("_order"))
    return relational.pick(df, ["source_url", "latitude", "longitude", "price_per_sqm_php"], F.col("_order").desc()).drop("_order", "_id")


def normalize_listings(raw: DataFrame, model: dict) -> DataFrame:
    """The listings that pass every check, deduplicated, with city_group."""
    checked = checked_listings(raw, model).where("ok_type and ok_price and ok_location and ok_provenance")
    return deduplicated(checked.drop("ok_type", "ok_price", "ok_location", "ok_provenance")).withColumn("city_group", text.area_key(F.col("city")))


def normalize_observations(raw: DataFrame, model: dict) -> DataFrame:
    """Market observations that pass, the last of each market_id, with market_group."""
    df = relational.conform(raw, OBSERVATIONS, required=REQUIRED)
    df = df.withColumn("underlying_listings", F.greatest(F.coalesce("underlying_listings", F.lit(1.0)), F.lit(1.0))).withColumn("property_type", text.property_type(F.col("property_type")))
    good = commercial_land(F.col("property_type"), model) & price_ok(F.col("price_per_sqm_php"), model) & provenance_ok(F.col("source"), F.col("source_url"), F.col("observed_at"))
    df = df.where(good & text.filled(F.col("market_id")) & text.filled(F.col("city")))
    order = F.struct(F.coalesce("_seq", F.lit(0)), *(c for c in df.columns if c != "_seq"))
    df = relational.pick(df.withColumn("_order", order), ["market_id"], F.col("_order").desc()).drop("_order")
    return df.withColumn("market_group", F.concat(text.area_key(F.col("city")), F.lit("|"), text.area_key(F.col("province"))))


def anchors(observations: DataFrame, model: dict, city: str = "city", price: str = "price_per_sqm_php", listings: str = "underlying_listings") -> DataFrame:
    """A row per city key with enough observations: the weighted lower median price in
    logarithms (weights: roots of listings) and the half width of its interval."""
    rows = observations.select(text.area_key(F.col(city)).alias("city_key"), F.log(price).alias("log_price"), F.sqrt(listings).alias("weight"), F.col(listings).alias("n_listings"))
    # Equal prices of a city are one row from here on, and the observations are read once.
    rows = keep(rows.groupBy("city_key", "log_price").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum("n_listings").alias("n_listings")))
    n = rows.groupBy("city_key").agg(F.sum("n").alias("n_observations"), F.sum("n_listings").alias("n_listings")).where(F.col("n_observations") >= model["minimum_top_anchor_observations"])
    rows = rows.select("city_key", "log_price", "weight").join(n, "city_key")
    middle = stats.weighted_quantile(rows, "log_price", "weight", 0.5, ["city_key"], "log_anchor")
    off = rows.join(middle, "city_key").withColumn("off", F.abs(F.col("log_price") - F.col("log_anchor")))
    mad = stats.weighted_quantile(off, "off", "weight", 0.5, ["city_key"], "mad")
    half = model["anchor_interval_z"] * 1.4826 * F.col("mad") / F.sqrt("n_observations")
    half = F.least(F.greatest(half, F.lit(model["anchor_interval_min_log"])), F.lit(model["anchor_interval_max_log"]))
    return n.join(middle, "city_key").join(mad, "city_key").select("city_key", F.exp("log_anchor").alias("anchor_price"), half.alias("half_width"), "n_observations", "n_listings")


def anchor_labels(observations: DataFrame, city: str = "city") -> DataFrame:
    """(city_key, city, province, market_areas, source_urls): names for each anchor, lists sorted."""
    texts = lambda c: F.array_sort(F.collect_set(c))
    one = F.min(F.struct(F.coalesce("_seq", F.lit(0)), city, "province")).alias("one")
    return observations.groupBy(text.area_key(F.col(city)).alias("city_key")).agg(one, texts("market_area").alias("market_areas"), texts("source_url").alias("source_urls")).select("city_key", f"one.{city}", "one.province", "market_areas", "source_urls")


def calibrations(observations: DataFrame, city: str = "city", price: str = "price_per_sqm_php", listings: str = "underlying_listings") -> DataFrame:
    """(city_key, price, n_observations, n_listings): means weighted by listings."""
    return observations.groupBy(text.area_key(F.col(city)).alias("city_key")).agg((F.sum(F.col(price) * F.col(listings)) / F.sum(listings)).alias("price"), F.count("*").alias("n_observations"), F.sum(listings).alias("n_listings"))


def donors(anchor: DataFrame, economics: DataFrame, cell_counts: DataFrame) -> DataFrame:
    """Anchors with deposits per land cell; those without deposits or cells go."""
    found = anchor.join(economics, "city_key").join(cell_counts, "city_key").where("bank_deposits_php > 0 and n_land_cells > 0")
    return found.withColumn("deposits_per_cell", F.col("bank_deposits_php") / F.col("n_land_cells"))


def comparable(targets: DataFrame, donor: DataFrame, model: dict, target: str = "city_key") -> DataFrame:
    """(target, price, half_width, n_donors) of targets (city_key, deposits_per_cell): the
    nearest donors in logarithms of deposits per cell, their prices scaled by the
    ratio, averaged by similarity. donor: the anchored cities."""
    f = model["comparable_city_fallback"]
    give = donor.where("deposits_per_cell > 0 and anchor_price > 0").select(F.col("city_key").alias("donor_key"), F.col("deposits_per_cell").alias("donor_density"), "anchor_price", F.col("half_width").alias("donor_half"))
    ask = targets.where("deposits_per_cell > 0").select(target, "deposits_per_cell")
    ratio = F.col("deposits_per_cell") / F.col("donor_density")
    near = relational.nearest(ask, give, target, F.abs(F.log(ratio)), max(1, f["n_neighbors"]), F.col("donor_key"))
    scaled = F.col("anchor_price") * F.pow(F.least(F.greatest(ratio, F.lit(f["deposit_ratio_min"])), F.lit(f["deposit_ratio_max"])), F.lit(f["deposit_ratio_exponent"]))
    weight = F.greatest(F.exp(-0.5 * F.pow(F.col("distance") / max(f["similarity_bandwidth_log"], 1e-6), 2)), F.lit(1e-6))
    near = keep(near.withColumn("scaled", scaled).withColumn("w", weight))
    log = F.log("scaled")
    total = F.sum("w")
    mean = near.groupBy(target).agg((F.sum(log * F.col("w")) / total).alias("mean_log"))
    spread = near.join(mean, target)
    out = spread.groupBy(target).agg(
        (F.sum(F.col("scaled") * F.col("w")) / total).alias("price"),
        F.sqrt(F.sum(F.pow(log - F.col("mean_log"), 2) * F.col("w")) / total).alias("spread"),
        (F.sum(F.col("donor_half") * F.col("w")) / total).alias("half"),
        F.count("*").alias("n_donors"),
    )
    half = F.least(F.greatest(F.greatest("half", 1.2816 * F.col("spread")), F.lit(f["interval_min_log"])), F.lit(f["interval_max_log"]))
    return out.select(target, "price", half.alias("half_width"), "n_donors")


def blended(cells: DataFrame, estimate: str, out: str, blend: float, by: list[str], score: str = "land_value_score", area: str = "area_sqm") -> DataFrame:
    """The estimate's own variation and the score's, mixed as powers, with the group's
    area-weighted mean of the estimate kept."""
    if blend <= 0:
        return cells.withColumn(out, F.col(estimate))
    blend, eps = min(blend, 1.0), F.lit(1e-6)
    df = cells.withColumn("_s", F.greatest(F.col(score), eps)).withColumn("_b", F.greatest(F.col(estimate), eps))
    df = stats.with_group(df, by, _ms=stats.weighted_mean(F.col("_s"), F.col(area)), _mb=stats.weighted_mean(F.col("_b"), F.col(area)))
    rel = lambda c, m: F.log(F.col(c) / F.greatest(F.col(m), eps))
    df = df.withColumn("_c", F.exp((1 - blend) * rel("_b", "_mb") + blend * rel("_s", "_ms")))
    df = stats.with_group(df, by, _mc=stats.weighted_mean(F.col("_c"), F.col(area)))
    return df.withColumn(out, F.col("_mb") * F.col("_c") / F.greatest(F.col("_mc"), eps)).drop("_s", "_b", "_ms", "_mb", "_c", "_mc")


def anchor_surface(cells: DataFrame, anchor: str, out: str, model: dict, by: list[str], score: str = "land_value_score") -> DataFrame:
    """The anchor price at the score's configured quantile, spread over the scores by a
    bounded power of their ratio."""
    q, eps = model["top_anchor_score_quantile"], F.lit(1e-6)
    df = stats.with_group(cells, by, _q=stats.quantile(score, q))
    m = F.pow(F.greatest(F.col(score), eps) / F.greatest(F.col("_q"), eps), F.lit(model["relative_score_elasticity"]))
    m = F.least(F.greatest(m, F.lit(model["relative_multiplier_min"])), F.lit(model["relative_multiplier_max"]))
    return df.withColumn(out, F.col(anchor) * F.when(F.col("_q").isNull(), 1.0).otherwise(m)).drop("_q")


PRICES = ("land_price_php_sqm", "land_price_low_php_sqm", "land_price_high_php_sqm", "land_price_market_baseline_php_sqm")


def empty_prices(cells: DataFrame) -> DataFrame:
    return cells.withColumns({c: F.lit(None).cast("double") for c in PRICES})


def price_cells(cells: DataFrame, anchor: DataFrame, observed: DataFrame, compared: DataFrame, model: dict, residual_low: float = 0.0, residual_high: float = 0.0, city: str = "city_key") -> DataFrame:
    """cells with the four prices, price_source and price_interval. Of a city's anchor, its
    observed mean and its comparable baseline the first that it has counts; cells
    outside the metro, and cities with none, stay null.

    anchor: city_key, anchor_price, half_width; observed: city_key, price; compared:
    city_key, price, half_width. residual_low and _high: quantiles of held-out
    logarithmic residuals, for observed means."""
    a = anchor.select(city, "anchor_price", F.col("half_width").alias("_ha"))
    o = observed.select(city, F.col("price").alias("_po"))
    c = compared.select(city, F.col("price").alias("_pc"), F.col("half_width").alias("_hc"))
    df = cells.join(a, city, "left").join(o, city, "left").join(c, city, "left")
    inside = F.coalesce(F.col("in_metro"), F.lit(False))
    flat = F.coalesce("_po", "_pc")
    source = F.when(~inside, F.lit(None)).when(F.col("anchor_price").isNotNull(), "top_market_anchor").when(F.col("_po").isNotNull(), "observed_market_calibration").when(F.col("_pc").isNotNull(), "deposit_per_cell_comparable_cities")
    df = keep(df.withColumn("price_source", source).withColumn("_flat", flat))
    out = df.where(F.col("price_source").isNull()).withColumn("_p", F.lit(None).cast("double"))
    top = anchor_surface(df.where("price_source = 'top_market_anchor'"), "anchor_price", "_p", model, [city])
    rest = blended(df.where("price_source <> 'top_market_anchor'"), "_flat", "_p", model["relative_score_blend"], [city])
    df = out.unionByName(top).unionByName(rest)
    by_anchor, by_peer = F.col("price_source") == "top_market_anchor", F.col("price_source") == "deposit_per_cell_comparable_cities"
    low = F.when(by_anchor, -F.col("_ha")).when(by_peer, -F.col("_hc")).otherwise(F.lit(float(residual_low)))
    high = F.when(by_anchor, F.col("_ha")).when(by_peer, F.col("_hc")).otherwise(F.lit(float(residual_high)))
    clip = lambda x: F.when(F.col("_p").isNotNull(), F.least(F.greatest(x, F.lit(model["min_price_per_sqm_php"])), F.lit(model["max_price_per_sqm_php"])))
    interval = F.when(by_anchor, "local_top_market_anchor_80pct").when(by_peer, "comparable_city_deposit_per_cell_ratio_80pct").when(F.col("_p").isNotNull(), "held_out_city_residual_q10_q90")
    return df.withColumns({
        PRICES[0]: clip(F.col("_p")),
        PRICES[1]: clip(F.col("_p") * F.exp(low)),
        PRICES[2]: clip(F.col("_p") * F.exp(high)),
        PRICES[3]: F.when(F.col("_p").isNotNull(), F.coalesce("anchor_price", "_flat")),
        "price_interval": interval,
    }).drop("anchor_price", "_ha", "_po", "_pc", "_hc", "_flat", "_p")


def log_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """log_<column> = log(1 + value), negatives as 0; null stays null."""
    put = lambda c: F.when(text.finite(F.col(c)).isNotNull(), F.log1p(F.greatest(text.finite(F.col(c)), F.lit(0.0))))
    return df.withColumns({f"log_{c}": put(c) for c in columns})


def listing_features(listings: DataFrame, cells: DataFrame) -> DataFrame:
    """Listings with the columns of their cell: the named city's cell if that city has
    cells at all, else the one of any city with the nearest downtown. Listings
    without a cell go. listings: _id, city_group, cell; cells: city_key, cell, dist_cbd_km."""
    known = cells.select(F.col("city_key").alias("city_group"), F.lit(True).alias("_known")).distinct()
    ask = listings.join(known, "city_group", "left")
    met = ask.join(cells, "cell").where(F.col("_known").isNull() | (F.col("city_group") == F.col("city_key")))
    return relational.pick(met, ["_id"], F.col("dist_cbd_km"), F.col("city_key")).drop("_known")


def market_frame(observations: DataFrame, reference: DataFrame) -> DataFrame:
    """Observations with their area's economics; unmatched ones have economics_status unmatched."""
    from . import economics

    place = F.concat_ws(", ", "city", "province", F.lit("Philippines"))
    found = economics.attach(observations.withColumn("place", place).select("market_id", "place"), reference, "market_id")
    keep = ["market_id", "economics_status", *economics.AREA_COLUMNS, "bank_deposits_per_capita_php", "local_tax_revenue_per_capita_php"]
    return observations.join(found.select(*keep), "market_id", "left")


def imported(existing: DataFrame, incoming: DataFrame, model: dict) -> DataFrame:
    """Both tables' listings, normalised and deduplicated together, the existing first."""
    written = lambda df: df.drop("_seq").select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.drop("_seq").columns))
    numbered = lambda df, base: written(df).withColumn("_seq", F.monotonically_increasing_id() + base)
    return normalize_listings(numbered(existing, 0).unionByName(numbered(incoming, 1 << 60), allowMissingColumns=True), model)


