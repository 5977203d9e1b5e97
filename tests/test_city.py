"""The whole run on synthetic cities, and the queries against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from terrasift.config import Config
from terrasift.functions.hexgrid import Lattice
from terrasift.operators import learning
from terrasift.plans import catalogue, city
from terrasift.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_run_over_two_cities(spark):
    config = Config()
    places = spark.createDataFrame([(0, "Cebu City, Philippines"), (1, "Davao City, Philippines")], "city int, place string")
    reference = spark.createDataFrame([("Cebu", "metro", 7e11, 1e6), ("Davao", "city", 4e11, 2e6)], "core_city string, deposit_scope string, bank_deposits_php double, city_population double")
    obs = spark.createDataFrame([("Cebu", "Cebu", f"a{i}", "https://x", 1000.0 * i, 1.0, i) for i in range(20, 25)], "city string, province string, market_area string, source_url string, price_per_sqm_php double, underlying_listings double, _seq int")
    steps = []
    found = city.run(spark, config, readers.synthetic_city(spark, config, 2), places, reference, obs, progress=lambda share, what: steps.append(share))
    assert steps == sorted(steps) and steps[-1] == 1.0
    cells = found.cells.toPandas()
    assert set(cells["city"]) == {0, 1} and not cells.duplicated(["city", "cell"]).any()
    assert cells["land_value_index"].between(0, 100).all() and (cells.groupby("city")["relative_value_share"].sum().sub(1).abs() < 1e-9).all()
    # Nothing lies in the bay, and downtown lies near the core.
    assert (cells.apply(lambda r: math.hypot(r.x - 4, r.y + 4), axis=1) > 2.9).all()
    assert (cells.groupby("city")["in_metro"].sum() > 10).all()
    assert set(cells.loc[cells["in_metro"], "price_source"]) == {"top_market_anchor", "deposit_per_cell_comparable_cities"}
    assert cells.loc[~cells["in_metro"], "land_price_php_sqm"].isna().all()
    lattice = Lattice((10.3157, 123.8854))
    layer = sinks.cell_features(found.cells, lattice)
    assert layer.count() == len(cells) and '"ppsm"' in layer.first()["feature"]
    water = sinks.water_features(found.grid, found.cells, readers.synthetic_city(spark, config, 2).water, lattice)
    assert water.count() == found.grid.count() - len(cells) + 2
    assert sinks.metro_features(found.cells, lattice).count() == 2
    total = sinks.summary(found.cells, lattice).collect()
    assert sum(r.n_metro for r in total) == cells["in_metro"].sum()
    assert {r.economics_status for r in found.metadata.collect()} == {"matched"}


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(catalogue.QUERIES) > 50


@pytest.mark.parametrize("name", ["accessibility_index", "gravity_access", "listing_normalization", "price_dispatch", "best_reference_match", "road_length_by_cell", "components_ring1", "percent_rank_avg_ties", "metro_polygon", "city_summary", "map_layers", "spatial_labels"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = catalogue.QUERIES[name](spark, SF)
    rel = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(made.columns)
    put = lambda r: tuple("" if v is None else repr(v) for v in r)
    assert sorted(map(put, made.select(*columns).collect())) == sorted(map(put, rel.fetchall()))


def test_feature_table_is_read_by_city(spark, tmp_path):
    df = spark.createDataFrame([(0, 1), (1, 2)], "city int, cell long")
    sinks.write_features(df, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").where(F.col("city") == 1).count() == 1


def test_weights_are_fitted_on_every_customer(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(learning, "fit_weight_model", lambda labels, model: seen.append(labels.collect()) or {"weights": {}, "minimum_weights": {}})
    catalogue.QUERIES["simplex_weight_fit"](spark, SF)
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    n = customers.agg(F.sum(F.col("c_custkey") % 4 + 1)).first()[0]
    assert sum(r.listing_observations for r in seen[0]) == n
    assert len(seen[0]) == customers.select("c_nationkey", "c_mktsegment").distinct().count()
    price = customers.agg(F.sum((1000 + F.greatest("c_acctbal", F.lit(0.0))) * (F.col("c_custkey") % 4 + 1))).first()[0]
    assert sum(r.price_per_sqm_php * r.listing_observations for r in seen[0]) == pytest.approx(price)
