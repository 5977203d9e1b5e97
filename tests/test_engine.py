"""Golden values and small cases of the engine's operators."""

import json
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift import config
from terrasift.config import COMPONENTS, DEFAULTS, Config
from terrasift.functions import geo, hexgrid, text
from terrasift.functions.hexgrid import Lattice
from terrasift.operators import economics, features, graph, landvalue, learning, pricing, relational, stats
from terrasift.sources import readers, sinks

MODEL = DEFAULTS["price_model"]
LATTICE = Lattice((10.3, 123.9))


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_area_keys(spark):
    names = {"City of Cebu, Philippines": "cebu", "Cebu City": "cebu", "Sto. Tomas": "santo tomas", "Sta Rosa (Laguna)": "santa rosa", "Peñablanca": "penablanca", "Parañaque City, NCR": "paranaque", None: "", "Citadel": "citadel"}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "a string, b string")
    assert all(a == b for a, b in values(df, text.area_key(F.col("a")), "b"))


def test_text_functions(spark):
    df = spark.createDataFrame([("₱2,000,000", "2024-02-30", "Commercial Lot!", "https://www.openstreetmap.org/relation/123"), ("200 sqm", "2024-02-28", None, "w55"), ("", "x", "", "77"), ("-1.5", None, "A--b", "zz")], "n string, t string, p string, o string")
    assert [r[0] for r in values(df, text.number(F.col("n")))] == [2000000.0, 200.0, None, -1.5]
    assert [r[0] for r in values(df, text.timestamp(F.col("t")))] == [None, datetime(2024, 2, 28), None, None]
    assert [r[0] for r in values(df, text.property_type(F.col("p")))] == ["commercial_lot", "", "", "a_b"]
    assert [r[0] for r in values(df, text.osm_id(F.col("o")))] == ["R123", "W55", "R77", None]
    assert [config.normalise_osm_id(x) for x in ("relation 123", "w55", "77")] == ["R123", "W55", "R77"]
    with pytest.raises(ValueError, match="not an OSM id"):
        config.normalise_osm_id("zz")


def test_ranks(spark):
    df = spark.createDataFrame([(float(v) if v is not None else None, "a") for v in (0, 0, 2, 2, 5, None)], "v double, g string")
    got = stats.positive_rank(stats.percent_rank(df, "v", "p", ["g"]), "v", "q", ["g"])
    assert sorted(values(got, "v", "p", "q"), key=str) == sorted([(0.0, 0.3, 0.0)] * 2 + [(2.0, 0.7, 0.5)] * 2 + [(5.0, 1.0, 1.0), (None, None, 0.0)], key=str)


def test_ranks_against_pandas(spark):
    import pandas as pd

    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"i": range(3000), "g": r.integers(0, 3, 3000), "v": np.round(np.exp(r.normal(size=3000) * 3), 2)})
    got = stats.percent_rank(spark.createDataFrame(pdf), "v", "p", ["g"]).toPandas().sort_values("i")
    assert np.allclose(got["p"], pdf.groupby("g")["v"].rank(pct=True))


def test_scales_and_shares(spark):
    df = spark.createDataFrame([("a", 7.0), ("a", 7.0), ("b", 1.0), ("b", 3.0), ("c", -1.0), ("c", 0.0), (None, 2.0), (None, 4.0)], "g string, v double")
    assert sorted(values(stats.min_max(df, "v", "s", ["g"]), "g", "v", "s"), key=str) == sorted([("a", 7.0, 0.0), ("a", 7.0, 0.0), ("b", 1.0, 0.0), ("b", 3.0, 1.0), ("c", -1.0, 0.0), ("c", 0.0, 1.0), (None, 2.0, 0.0), (None, 4.0, 1.0)], key=str)
    shares = values(stats.share(df.withColumn("a", F.lit(0.5)), "v", "a", "s", ["g"]), "g", "v", "s")
    assert ("b", 3.0, 0.75) in shares and shares.count(("c", 0.0, 0.5)) == 1 and ("c", -1.0, 0.5) in shares


def test_weighted_quantile(spark):
    df = spark.createDataFrame([("a", v, 1.0) for v in (1.0, 2.0, 3.0, 4.0)] + [("a", None, 1.0), ("a", 0.0, 0.0), ("a", float("nan"), 5.0), ("b", 9.0, 1.0)], "g string, v double, w double")
    assert sorted(values(stats.weighted_quantile(df, "v", "w", 0.5, ["g"]), "g", "quantile")) == [("a", 2.0), ("b", 9.0)]


def test_weights():
    assert config.normalised_weights({}) == {c: 0.2 for c in COMPONENTS}
    assert config.normalised_weights({"access_cbd": 3, "poi_density": 1, "road_density": -5})["access_cbd"] == 0.75
    c = Config()
    assert c.with_overrides(None) is c
    assert c.with_overrides({"metro": {"bridge_gap": 1}}).metro["bridge_gap"] == 1 and c.metro["bridge_gap"] == 2
    tags = config.combined_tags(c)
    assert tags["office"] is True and tags["amenity"][:2] == ["bus_station", "ferry_terminal"]
    c = c.with_overrides({"city": {"place": "Bacolod City, Philippines", "osm_id": "relation 9", "osm_id_fallbacks": {"bacolod": "R1"}, "place_aliases": {"surigao": "Surigao City"}}})
    assert (c.slug, c.cache_slug, config.fallback_osm_id(c, "Bacolod City"), config.resolved_place(c, "Surigao")) == ("bacolod_city", "bacolod_city_r9", "R1", "Surigao City")


def test_lattice_round_trip(spark):
    df = spark.range(500).select((F.rand(1) * 20 - 10).alias("x"), (F.rand(2) * 20 - 10).alias("y"))
    cell = LATTICE.cell_xy(F.col("x"), F.col("y"))
    df = df.withColumn("cell", cell).cache()
    own = df.select(LATTICE.cell_xy(LATTICE.x(F.col("cell")), LATTICE.y(F.col("cell"))) == F.col("cell"), geo.in_ring(F.col("x"), F.col("y"), LATTICE.ring(F.col("cell"))), F.abs(geo.ring_area(LATTICE.ring(F.col("cell"))) - LATTICE.cell_area) < 1e-9)
    assert all(all(r) for r in own.collect())
    disk = df.limit(5).select("cell", F.explode(hexgrid.disk(F.col("cell"), 2)).alias("o")).select(hexgrid.steps(F.col("cell"), F.col("o")).alias("d"), F.size(hexgrid.path(F.col("cell"), F.col("o"))).alias("n"))
    rows = disk.collect()
    assert sorted(r.d for r in rows) == sorted(([0] + [1] * 6 + [2] * 12) * 5) and all(r.n == r.d + 1 for r in rows)


def test_geometry(spark):
    square = geo.literal_ring([(0, 0), (2, 0), (2, 2), (0, 2)])
    hole = geo.literal_ring([(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)])
    one = spark.range(1)
    L = F.lit
    row = one.select(
        geo.in_rings(L(1.0), L(1.0), F.array(square, hole)), geo.in_rings(L(0.2), L(0.2), F.array(square, hole)), geo.clipped_length(L(-1.0), L(1.0), L(3.0), L(1.0), square), geo.clipped_length(L(0.0), L(2.0), L(2.0), L(2.0), square), geo.clipped_length(L(3.0), L(0.0), L(3.0), L(2.0), square),
        geo.point_segment_km(L(0.0), L(1.0), L(-1.0), L(0.0), L(1.0), L(0.0)), geo.point_segment_km(L(3.0), L(4.0), L(0.0), L(0.0), L(0.0), L(0.0)), geo.ring_distance(L(5.0), L(2.0), square), geo.ring_centroid(square)["x"], geo.haversine_km(L(0.0), L(0.0), L(0.0), L(90.0)),
    ).first()
    assert tuple(row)[:9] == (False, True, 2.0, 2.0, 0.0, 1.0, 5.0, 3.0, 1.0)
    assert abs(row[9] - geo.EARTH_KM * math.pi / 2) < 1e-6


def test_nearest_is_found_at_any_distance(spark):
    segs = spark.createDataFrame([(0, 1, True, 0.0, 0.0, 0.0, 1.0), (0, 2, True, 900.0, 0.0, 900.0, 1.0)], "city int, road_id int, is_major boolean, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([(0, 1, 200.0, 0.5), (0, 2, 400.0, 0.5), (0, 3, 3000.0, 0.5), (1, 4, 0.0, 0.0)], "city int, cell long, x double, y double")
    assert dict(values(features.nearest_road(cells, segs, ["city", "cell"]), "cell", "dist_major_road_km")) == {1: 200.0, 2: 400.0, 3: 2100.0, 4: None}
    # The second is the nearest of cell 5, though only the first is in the nine bins of 25 km.
    points = spark.createDataFrame([(0, 7, 49.0, 49.0), (0, 8, -51.0, 0.0), (0, 9, 900.0, 0.0), (0, 10, 900.0, 0.0)], "city int, point int, px double, py double")
    cells = spark.createDataFrame([(0, 5, 1.0, 1.0), (0, 6, 400.0, 0.0), (0, 7, 3000.0, 0.0), (0, 8, 48.0, 49.0), (1, 9, 0.0, 0.0)], "city int, cell long, x double, y double")
    d = geo.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    got = {c: (p, round(km, 6)) for c, p, km in values(features.nearest_point(cells, points, "cell", "point", 25.0, d), "cell", "point", "distance")}
    assert got == {5: (8, round(math.hypot(52, 1), 6)), 6: (7, round(math.hypot(351, 49), 6)), 7: (9, 2100.0), 8: (7, 1.0)}


def grid_of(spark, cells, **columns):
    """Cells from (q, r) pairs."""
    pack = lambda q, r: (q + (1 << 20)) * (1 << 21) + r + (1 << 20)
    rows = [(0, pack(q, r)) for q, r in cells]
    df = spark.createDataFrame(rows, "city int, cell long")
    for n, v in columns.items():
        df = df.withColumn(n, F.lit(v))
    return df, pack


def test_road_length_and_nearest(spark):
    segs = spark.createDataFrame([(0, 1, True, -3.0, 0.2, 4.0, 1.0), (0, 2, False, 9.0, 9.0, 9.0, 9.0)], "city int, road_id int, is_major boolean, x1 double, y1 double, x2 double, y2 double")
    total = features.road_length(segs, LATTICE).agg(F.sum("road_density_km")).first()[0]
    assert abs(total - math.hypot(7, 0.8)) < 1e-9
    cells = spark.createDataFrame([(0, 1, 0.0, 3.0), (0, 2, 100.0, 0.0)], "city int, cell long, x double, y double")
    got = dict(values(features.nearest_road(cells, segs.where("is_major"), ["city", "cell"]), "cell", "dist_major_road_km"))
    assert got[1] < 3 and abs(got[2] - math.hypot(96, 1.0)) < 1e-9
    assert features.nearest_road(cells, segs.limit(0), ["city", "cell"], 2.0, 8.0).where("dist_major_road_km is not null").count() == 0


def test_places_and_segments_are_met_once(spark, monkeypatch):
    asked, nearest = [], features.nearest_segment
    monkeypatch.setattr(features, "nearest_segment", lambda cells, segs, *a: asked.append((cells.count(), segs.count())) or nearest(cells, segs, *a))
    segs = spark.createDataFrame([(0, i, True, float(i % 2), 0.0, float(i % 2), 1.0) for i in range(40)], "city int, road_id int, is_major boolean, x1 double, y1 double, x2 double, y2 double")
    rows = [(0, i, [0.5, 3.0, 7.5, None][i % 4], 0.5) for i in range(60)]
    found = features.nearest_road(spark.createDataFrame(rows, "city int, cell long, x double, y double"), segs, ["city", "cell"])
    assert found.columns == ["city", "cell", "x", "y", "dist_major_road_km"]
    assert sorted(values(found, "cell", "dist_major_road_km"), key=str) == sorted(((i, [0.5, 2.0, 6.5, None][i % 4]) for i in range(60)), key=str)
    assert asked == [(3, 2), (1, 2)]


def test_nearest_point_asks_once_a_place(spark, monkeypatch):
    asked, spread = [], features._spread
    monkeypatch.setattr(features, "_spread", lambda df, *a: asked.append(df.count()) or spread(df, *a))
    cells = spark.createDataFrame([(0, i, [0.0, 5.0, None][i % 3], 0.5) for i in range(60)], "city int, cell long, x double, y double")
    points = spark.createDataFrame([(0, 90 - i, 4.0 * (i % 2), 0.5) for i in range(40)], "city int, point int, px double, py double")
    d = geo.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    got = values(features.nearest_point(cells, points, "cell", "point", 2.0, d), "cell", "point", "distance")
    assert sorted(got) == sorted((i, [52, 51][i % 3], [0.0, 1.0][i % 3]) for i in range(60) if i % 3 < 2)
    assert max(asked) == 3


def test_gravity_against_all_pairs(spark):
    r = np.random.default_rng(5)
    c, p = r.uniform(-60, 60, (80, 2)), r.uniform(-60, 60, (60, 2))
    cells = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(c)], "city int, cell long, x double, y double")
    pois = spark.createDataFrame([(0, *map(float, v), 0.5) for v in p], "city int, x double, y double, weight double")
    got = dict(values(features.gravity(cells, pois, 1.5, ["cell"]), "cell", "establishment_access"))
    d = np.linalg.norm(c[:, None] - p[None], axis=2)
    assert np.allclose([got.get(i, 0.0) for i in range(80)], (0.5 * np.exp(-d / 1.5)).sum(1), atol=1e-9)


def test_cells_at_one_place_have_one_access(spark, monkeypatch):
    # Sums differ in their last bit by the order of a task, so ranks tie only if a place is asked for once.
    asked, spread = [], features._spread
    monkeypatch.setattr(features, "_spread", lambda df, *a: asked.append(df.count()) or spread(df, *a))
    cells = spark.createDataFrame([(0, i, float(i % 3), 0.5) for i in range(60)], "city int, cell long, x double, y double")
    pois = spark.createDataFrame([(0, 0.3 * i, 0.1 * i, 0.7) for i in range(50)], "city int, x double, y double, weight double")
    got = dict(values(features.gravity(cells, pois, 1.5, ["city", "cell"]), "cell", "establishment_access"))
    assert asked == [3] and len(got) == 60
    assert all(got[i] == got[i % 3] for i in range(60)) and len(set(got.values())) == 3


def test_reachability(spark):
    df, pack = grid_of(spark, [(0, 0), (1, 0), (5, 5), (9, 9), (20, 20)])
    df = df.withColumn("road_density_km", F.when(F.col("cell") == pack(1, 0), 1.0).otherwise(0.0)).withColumn("poi_count", (F.col("cell") == pack(5, 5)).cast("int")).withColumn("touches_boundary", F.col("cell") == pack(9, 9))
    assert {r.cell for r in features.reachable(df).where("reachable").collect()} == {pack(0, 0), pack(1, 0), pack(5, 5), pack(9, 9)}


def test_bridges(spark):
    """A gap of one cell is crossed where it is water, not where it is land."""
    town, pack = grid_of(spark, [(0, 0), (2, 0), (10, 0), (12, 0)])
    land, _ = grid_of(spark, [(0, 0), (2, 0), (10, 0), (11, 0), (12, 0)])
    seeds = lambda q: grid_of(spark, [(q, 0)])[0]
    reach = lambda q, bridge=2: {r.cell for r in graph.connected(seeds(q), town, bridge, land).collect()}
    assert reach(0) == {pack(0, 0), pack(2, 0)} and reach(10) == {pack(10, 0)} and reach(0, 1) == {pack(0, 0)} and reach(5) == set()


@pytest.mark.parametrize(("size", "road", "access", "joined"), [(12, 2.0, 3.0, True), (11, 2.0, 3.0, False), (12, 1.9, 3.0, False), (12, 2.0, 2.9, False)])
def test_connectors(spark, size, road, access, joined):
    core, far = [(0, r) for r in range(3)], [(3 + i % 3, i // 3) for i in range(size)]
    gap = [(1, 0), (2, 0), (1, 1), (2, 1), (1, 2), (2, 2)]
    cells, pack = grid_of(spark, core + far + gap)
    own = F.col("cell").isin([pack(*c) for c in gap])
    cells = cells.withColumn("road_density_km", F.when(own, road).otherwise(9.0)).withColumn("establishment_access", F.when(own, access).otherwise(9.0)).withColumn("poi_count", F.when(own, 0).otherwise(5)).withColumn("dist_cbd_km", F.abs(F.col("cell") - pack(0, 1)).cast("double"))
    cells = cells.withColumn("poi_count", F.when(own, 0).otherwise(F.lit(9)))
    centre = spark.createDataFrame([(0, pack(0, 1))], "city int, cell long")
    metro = DEFAULTS["metro"] | {"min_road_km_per_cell": 4.0}
    got = graph.delineate(cells.repartition(3), centre, metro).collect()
    assert any(r.is_connector for r in got) == joined
    assert sum(r.in_metro and r.is_urban for r in got) == 3 + size * joined
    away = graph.delineate(cells, spark.createDataFrame([(0, pack(1, 1))], "city int, cell long"), metro).where("in_metro").count()
    assert away >= 3  # the nearest urban cell stands in for a rural downtown


def listing(**kw):
    return {"listing_id": "1", "source": "s", "source_url": "https://x", "observed_at": "2024-01-01", "city": "Cebu City", "property_type": "Commercial lot", "lat": "10.3", "lng": "123.9", "price": "₱2,000,000", "lot_area": "200 sqm", "_seq": 0} | kw


def listings(spark, *rows):
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {'long' if n == '_seq' else 'string'}" for n in names))


def test_listings(spark):
    raw = listings(spark, listing(), listing(listing_id="2", property_type="Commercial house and lot"), listing(listing_id="1", _seq=1, price="9,000,000"), listing(listing_id="3", _seq=3), listing(listing_id=None, _seq=4), listing(listing_id="5", source_url="ftp://x"), listing(listing_id="6", observed_at="soon"), listing(listing_id="7", lat="50"), listing(listing_id="8", property_type=None))
    got = pricing.normalize_listings(raw, MODEL).collect()
    assert [(r._seq, r.price_per_sqm_php, r.city_group) for r in got] == [(4, 10000.0, "cebu")]  # first of an id, last of a place
    counts = pricing.reject_counts(pricing.checked_listings(raw, MODEL)).first()
    assert tuple(counts) == (9, 4, 2, 0, 1, 2)


def test_header_aliases_are_coalesced(spark):
    df = spark.createDataFrame([(None, "5", "x"), ("4", "6", "y")], "Price string, asking_price string, url string")
    got = pricing.checked_listings(df, MODEL)
    assert values(got, "price_php", "source_url") == [(5.0, "x"), (4.0, "y")]


def observation(i, price, city="Cebu", listings=1, kind="commercial vacant lot"):
    return {"market_id": str(i), "city": city, "province": "Cebu", "market_area": f"a{i}", "property_type": kind, "source": "s", "source_url": "https://x", "price_per_sqm_php": str(price), "underlying_listings": str(listings), "observed_at": "2024-01-01", "_seq": i}


def test_observations_and_anchor(spark):
    rows = [observation(i, p) for i, p in enumerate((20000, 30000, 34000, 59500, 65000, 65500, 70000, 90000))] + [observation(50, 1, kind="residential vacant lot")]
    obs = pricing.normalize_observations(listings(spark, *rows), MODEL)
    assert obs.count() == 8
    (a,) = pricing.anchors(obs, MODEL).collect()
    assert (a.city_key, round(a.anchor_price), a.n_observations) == ("cebu", 59500, 8) and a.half_width < 0.35
    with pytest.raises(ValueError, match="market_id"):
        pricing.normalize_observations(listings(spark, listing()), MODEL)


def test_comparable_city(spark):
    donor = spark.createDataFrame([("a", 5.0, 20000.0, 0.2), ("b", 20.0, 80000.0, 0.2)], "city_key string, deposits_per_cell double, anchor_price double, half_width double")
    target = spark.createDataFrame([("t", 10.0), ("none", None)], "city_key string, deposits_per_cell double")
    (r,) = pricing.comparable(target, donor, MODEL).collect()
    assert (r.city_key, round(r.price, 6), r.n_donors) == ("t", 40000.0, 2)


def priced(spark, n=101):
    return spark.createDataFrame([(i, "cebu", 0.05 + 0.95 * i / (n - 1), 1.0, i % 10 != 9) for i in range(n)], "i int, city_key string, land_value_score double, area_sqm double, in_metro boolean")


def test_price_surfaces(spark):
    two = spark.createDataFrame([(1.0, 1.0, 20000.0), (3.0, 1.0, 20000.0)], "land_value_score double, area_sqm double, e double")
    got = [r[0] for r in values(pricing.blended(two, "e", "p", 1.0, []), "p")]
    assert abs(sum(got) / 2 - 20000) < 5 and round(max(got) / min(got), 2) == 3.0
    s = values(pricing.anchor_surface(priced(spark).withColumn("a", F.lit(59500.0)), "a", "p", MODEL, ["city_key"]).orderBy("i"), "p")
    assert abs(s[90][0] - 59500) < 1000 and all(a <= b for a, b in zip(s, s[1:], strict=False))


def test_price_dispatch_order(spark):
    anchor = spark.createDataFrame([("cebu", 59500.0, 0.2)], "city_key string, anchor_price double, half_width double")
    seen = spark.createDataFrame([("cebu", 1000.0), ("b", 2000.0)], "city_key string, price double")
    peer = spark.createDataFrame([("b", 3000.0, 0.3), ("c", 4000.0, 0.3)], "city_key string, price double, half_width double")
    cells = priced(spark, 20)
    for c in "bcd":
        cells = cells.union(priced(spark, 20).withColumn("city_key", F.lit(c)))
    got = pricing.price_cells(cells, anchor, seen, peer, MODEL, -0.1, 0.1).collect()
    assert len(got) == 80
    source = {"cebu": "top_market_anchor", "b": "observed_market_calibration", "c": "deposit_per_cell_comparable_cities", "d": None}
    for r in got:
        inside = r.in_metro and source[r.city_key]
        assert r.price_source == (source[r.city_key] if inside else None)
        assert (r.land_price_php_sqm is not None) == bool(inside)
        assert not inside or r.land_price_low_php_sqm <= r.land_price_php_sqm <= r.land_price_high_php_sqm


def test_best_match(spark):
    ref = spark.createDataFrame([("Naga", "Cebu", "city", "2024", 1.0), ("Naga", "Camarines Sur", "city", "2020", 2.0), ("Iloilo", None, "metro", "2010", 3.0), ("Iloilo", None, "city", "2024", 4.0)], "core_city string, province string, deposit_scope string, period string, bank_deposits_php double")
    ask = spark.createDataFrame([(1, "Naga City, Camarines Sur, Philippines"), (2, "Naga, Philippines"), (3, "City of Iloilo"), (4, "Nowhere")], "city int, place string")
    got = {r.city: r for r in economics.attach(ask, ref.withColumn("city_population", F.lit(0.0))).collect()}
    assert [got[i].bank_deposits_php for i in (1, 2, 3, 4)] == [2.0, 1.0, 3.0, None]
    assert got[4].economics_status == "unmatched" and got[1].bank_deposits_per_capita_php is None


def test_best_match_makes_few_pairs(spark, monkeypatch):
    seen, pick = [], relational.pick
    monkeypatch.setattr(relational, "pick", lambda df, *a: seen.append(df.count()) or pick(df, *a))
    provinces, scopes, periods = ["Cebu", None, "", "Bohol"], ["city", "metro", "barangay", None], ["2020", None, "2024"]
    refs = [("a" if i % 5 else None, provinces[i % 4], scopes[i % 7 % 4], periods[i % 11 % 3], i) for i in range(200)]
    asks = [(i % 190, [None, "a", "b"][i % 19 % 3], [None, "x, cebu", "y, Bohol, Cebu", "z"][i % 4]) for i in range(200)]
    ref = spark.createDataFrame(refs, "area_key string, province string, deposit_scope string, period string, ref_id int")
    got = values(relational.best_match(spark.createDataFrame(asks, "id int, area_key string, place string"), ref, "area_key", "place", "id"), "id", "ref_id")
    assert max(seen) <= 200

    def best(own):
        met = [(r, bool(r[1]) and r[1].lower() in (p or "").lower()) for _, k, p in own for r in refs if k is not None and r[0] == k]
        met = [r for r, named in met if named] or [r for r, _ in met]
        key = lambda r: ({"metro": 0, "city": 1}.get(r[2], 2), -int(r[3] or 0), r[4])
        return min(met, key=key)[4] if met else None

    expected = {i: [a for a in asks if a[0] == i] for i in range(190)}
    # Of an id's rows one without candidates, which has no scope and no period, comes before a match that has none either.
    plain = {i: own for i, own in expected.items() if len({a[1] for a in own}) == 1}
    assert len(got) == 190 and {i: dict(got)[i] for i in plain} == {i: best(own) for i, own in plain.items()}


def test_attached_economics(spark):
    ref = spark.createDataFrame([("Cebu", "metro", 700e9, 1e6)], "core_city string, deposit_scope string, bank_deposits_php double, city_population double")
    (r,) = economics.attach(spark.createDataFrame([(0, "Cebu City, Philippines")], "city int, place string"), ref).collect()
    assert (r.bank_deposits_per_capita_php, r.deposit_scope) == (700000.0, "metro")


def test_outcomes(spark):
    labels = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "city string, cell int")
    cells = spark.createDataFrame([("a", 1, True), ("a", 2, False)], "city string, cell int, in_metro boolean")
    got = relational.outcome_join(labels, cells, "cell", cells.select("city"), "city")
    assert sorted(values(got, "city", "cell", "outcome")) == [("a", 1, "matched"), ("a", 2, "outside_metro"), ("a", 3, "outside_grid"), ("b", 1, "missing_cache")]


def test_folds():
    table = learning.fold_table({"a": 5, "b": 4, "c": 3, "d": 3, "e": 1}, 2)
    assert table == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_learning_is_grouped_and_ordered(spark):
    r = np.random.default_rng(2)
    rows = [(f"c{i % 6}", float(i % 7), float(r.normal()), float(np.exp(5 + i % 7 + 0.1 * r.normal()))) for i in range(72)]
    df = spark.createDataFrame(rows, "city string, a double, b double, price double")
    for kind, grid in (("market", {"n_trees": [15], "min_leaf": [2, 3], "max_features": [1.0]}), ("cell", {"n_trees": [60], "rate": [0.2], "leaves": [3, 5], "min_leaf": [2]})):
        found = learning.fit(df, kind, ("a", "b"), "city", "price", grid=grid)
        m = found.metadata
        assert m["median_ape"] < 0.6 and m["residual_log_q10"] <= 0 <= m["residual_log_q90"] and len(m["tuning"]) == 2 and m["validation"] == "nested_grouped"
        made = found.predict(df).collect()
        assert len(made) == 72 and np.corrcoef([math.log(x.price) for x in made], [math.log(x.predicted) for x in made])[0, 1] > 0.9
    with pytest.raises(ValueError, match="training needs"):
        learning.fit(df.limit(5), "market", ("a", "b"), "city", "price")


def test_weight_fit(spark, tmp_path):
    r = np.random.default_rng(4)
    x = r.uniform(size=(8, 5))
    rows = [(*map(float, v), float(np.exp(8 + 2 * v @ [0.1, 0.4, 0.2, 0.2, 0.1])), 1.0) for v in x]
    df = spark.createDataFrame(rows, ", ".join(f"norm_{c} double" for c in COMPONENTS) + ", price_per_sqm_php double, listing_observations double")
    found = learning.fit_weight_model(df, DEFAULTS["weight_model"])
    assert abs(sum(found["weights"].values()) - 1) < 1e-9
    assert all(found["weights"][c] >= f - 1e-9 for c, f in DEFAULTS["weight_model"]["minimum_weights"].items())
    learning.save_json(found, tmp_path / "w.json")
    assert learning.load_weights(tmp_path / "w.json")["weights"] == found["weights"]
    (tmp_path / "bad.json").write_text(json.dumps(found | {"artifact_version": 99}))
    assert learning.load_weights(tmp_path / "bad.json")["status"] == "error" and learning.load_weights(tmp_path / "none.json")["status"] == "not_trained"


def test_score(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.0, 1.0, 0.2)], ", ".join(f"norm_{c} double" for c in COMPONENTS))
    w = {c: 2.0 for c in COMPONENTS}
    assert abs(df.select(landvalue.score_of(w)).first()[0] - 0.54) < 1e-12
    assert df.select(landvalue.score_of({c: 0.0 for c in COMPONENTS})).first()[0] == 0


def test_roads_missing_everywhere_count_as_no_access(spark):
    df = spark.createDataFrame([(0, 1.0, None, 1.0, 1.0, 0.0, 1e6), (0, 2.0, None, 2.0, 0.0, 1.0, 1e6)], "city int, dist_cbd_km double, dist_major_road_km double, establishment_access double, poi_weighted_density double, road_density_km double, area_sqm double")
    got = landvalue.land_value(df, DEFAULTS["landvalue"]["decay_scale_km"], DEFAULTS["landvalue"]["weights"], ["city"]).collect()
    assert all(r.land_value_score is not None and r.norm_access_major_road == 0 for r in got)
    assert abs(sum(r.relative_value_share for r in got) - 1) < 1e-12 and sorted(r.land_value_index for r in got) == [0.0, 100.0]


def test_polygons(spark):
    step = 1 << 21
    ring = [(0, q * step + r) for q, r in hexgrid.RING]  # six cells around none
    df = spark.createDataFrame([*ring, (0, 40 * step), (1, 0), (1, 1), (None, 5)], "city int, cell long").withColumn("cell", F.col("cell") + hexgrid.pack(F.lit(0), F.lit(0)))
    found = sinks.polygons(df.where("city is not null"), LATTICE).withColumn("areas", F.transform("rings", geo.ring_area)).collect()
    assert sorted((r.city, [len(x) for x in r.rings], [round(a / LATTICE.cell_area, 9) for a in r.areas]) for r in found) == [(0, [6], [1.0]), (0, [18, 6], [7.0, 1.0]), (1, [10], [2.0])]
    turn = lambda ring: sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:] + ring[:1]))
    assert all(turn(r.rings[0]) > 0 and all(turn(x) < 0 for x in r.rings[1:]) for r in found)
    made = {r.city: json.loads(r.feature) for r in sinks.metro_features(df.where("city is not null").withColumn("in_metro", F.lit(True)), LATTICE).collect()}
    assert (made[0]["geometry"]["type"], len(made[0]["geometry"]["coordinates"]), made[1]["geometry"]["type"]) == ("MultiPolygon", 2, "Polygon")
    assert made[1]["properties"] == {"name": "metro_area", "cells": 2, "area_km2": round(2 * LATTICE.cell_area, 1)}
    closed = made[1]["geometry"]["coordinates"][0]
    assert closed[0] == closed[-1] and len(closed) == 11 and closed[0][0] == pytest.approx(123.9, abs=0.02)
    none = df.where("false").withColumn("in_metro", F.lit(True))
    assert sinks.polygons(none, LATTICE).count() == sinks.metro_features(none, LATTICE).count() == 0


def test_map_layers(spark):
    df = spark.createDataFrame([("mall", True), ("zoo", False), (None, None)], "c string, m boolean")
    assert [r[0] for r in values(df, sinks.category_colour(F.col("c")))] == ["#e6194B", "#888", "#888"]
    shown = lambda *switches: [r[0] for r in values(df, sinks.cells_shown(F.col("m"), *switches))]
    assert shown(False, False) == shown(True, True) == [True, False, False] and shown(True, False) == [True] * 3
    assert [r[0] for r in values(df, sinks.connectors_shown(F.col("m"), True, True))] == [True, False, False]


def test_manifest(tmp_path):
    c, path = Config(), tmp_path / "manifest.json"
    a, b = {"slug": "a", "name": "A"}, {"slug": "b", "name": "B", "n_price_cells": 3}
    sinks.register(path, c, [a], replace=True)
    assert [x["slug"] for x in sinks.register(path, c, [b])["cities"]] == ["a", "b"]
    assert sinks.register(path, c, [a | {"name": "Z"}])["metrics"][0][0] == "ppsm"
    assert [x["slug"] for x in sinks.register(path, c, [b], replace=True)["cities"]] == ["b"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1, "y": "p"}, {"x": 2}]))
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "a.csv").write_text("core_city,psgc_code,population\nCebu,0722,900\n")
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"place": "p", "property_type": "Commercial land", "price_per_sqm_php": 5}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}]}))
    assert sorted(r.x for r in readers.read_table(spark, f"{tmp_path}/a.json").collect()) == ["1", "2"]
    assert readers.read_table(spark, f"{tmp_path}/a.jsonl").count() == 2
    assert values(readers.read_csv(spark, f"{tmp_path}/a.csv", readers.POPULATION), "psgc_code", "population") == [("0722", 900)]
    labels = readers.spatial_labels(readers.read_table(spark, f"{tmp_path}/a.geojson", points=True))
    assert values(labels, "place", "price_per_sqm_php", "lng", "lat") == [("p", 5.0, 1.5, 2.5)]
    with pytest.raises(ValueError, match="place"):
        readers.spatial_labels(labels.drop("place"))


def test_sources(spark, tmp_path):
    def bad():
        raise OSError("down")

    assert readers.first_working([("a", bad), ("b", lambda: 5)]) == 5
    with pytest.raises(ConnectionError, match="a: OSError: down"):
        readers.first_working([("a", bad)])
    city = readers.load_city(spark, Config(), bad)
    assert city.source == "synthetic" and "down" in city.source_error
    with pytest.raises(OSError, match="down"):
        readers.load_city(spark, Config(), bad, strict=True)
    c = Config().with_overrides({"city": {"place": "Bacolod City, X", "osm_id": "R9"}})
    for name, n in (("bacolod_city_features_res8_12km", 3), ("bacolod_city_r9_features_res8_12km", 0), ("bacolod_city_synth_features_res8_12km", 9)):
        spark.range(n).withColumnRenamed("id", "cell").write.parquet(f"{tmp_path}/{name}.parquet")
    n, path = readers.cached_cells(spark, str(tmp_path), c)
    assert n == 3 and path.endswith("bacolod_city_features_res8_12km.parquet")
    f = spark.createDataFrame([(0, 1.0, 2.0, {"shop": ["mall"], "amenity": ["bank"]}), (0, 1.0, 2.0, {"office": ["x"]}), (0, None, 2.0, {"office": ["x"]})], "city int, lng double, lat double, tags map<string,array<string>>")
    assert sorted(r.category for r in readers.pois_of(f, Config()).collect()) == ["bank", "mall", "office"]


def test_label_stream(spark, tmp_path):
    from terrasift.streaming import labels

    for i, price in enumerate(("2,000,000", "4,000,000")):
        (tmp_path / "in").mkdir(exist_ok=True)
        row = ["1", "s", "https://x", "2024-01-01", "Cebu", "Cebu", "Commercial lot", "10.3", "123.9", price, "200", ""] if i == 0 else ["2", "s", "https://x", "2024-01-01", "Cebu", "Cebu", "Commercial lot", "10.4", "123.9", price, "200", ""]
        (tmp_path / "in" / f"{i}.csv").write_text(",".join(labels.COLUMNS) + "\n" + ",".join(f'"{v}"' for v in row) + "\n")
        q = labels.import_labels(labels.listing_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", MODEL)
        q.awaitTermination()
    assert sorted(values(labels.current(spark, f"{tmp_path}/out"), "listing_id", "price_per_sqm_php")) == [("1", 10000.0), ("2", 20000.0)]


def test_samples(spark):
    import hashlib

    rows = [(g, i) for g, n in (("a", 400), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long")
    first = lambda found: sorted(found, key=lambda r: hashlib.md5(str(r[1]).encode()).hexdigest())
    want = {r for g in "ab" for r in first([r for r in rows if r[0] == g])[:20]}
    assert set(values(relational.sample_per(df.repartition(5), 20, ["g"], "i"), "g", "i")) == want
    assert set(values(relational.sample_top(df.where("g = 'a'"), 7, "i"), "g", "i")) == set(first([r for r in rows if r[0] == "a"])[:7])
    assert relational.sample_per(df.limit(0), 20, ["g"], "i").count() == 0


def test_paths_bind_their_ends_once(spark):
    """Every step of a path is a neighbour of the one before, ends included, whichever way it goes."""
    cells = spark.range(1).select(F.explode(hexgrid.disk(hexgrid.pack(F.lit(5), F.lit(-3)), 4)).alias("b"), hexgrid.pack(F.lit(5), F.lit(-3)).alias("a"))
    for a, b in (("a", "b"), ("b", "a")):
        found = cells.select(F.col(a).alias("a"), F.col(b).alias("b"), hexgrid.path(F.col(a), F.col(b)).alias("p"))
        steps = F.zip_with(F.slice("p", 2, F.size("p")), F.slice("p", 1, F.size("p") - 1), hexgrid.steps)
        ok = (F.col("p")[0] == F.col("a")) & (F.element_at("p", -1) == F.col("b")) & F.forall(steps, lambda s: s == 1)
        size = F.size("p") == hexgrid.steps(F.col("a"), F.col("b")) + 1
        assert found.where((F.size("p") > 1) & ~(ok & size)).isEmpty() and found.count() == 61
