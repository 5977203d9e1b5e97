"""Queries on validation and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import COMPONENTS, DEFAULTS
from ..operators import learning
from .bindings import table

QUERIES, ORACLES = {}, {}


def group_kfold(spark, d):
    """Customers' nations dealt to five folds, the largest first to the lightest."""
    df = learning.with_folds(table(spark, d, "customer").withColumn("nation", F.col("c_nationkey").cast("string")), "nation", 5)
    return df.groupBy("nation").agg(F.min("fold").alias("fold"), F.count("*").alias("n"))


QUERIES["group_kfold"] = group_kfold
ORACLES["group_kfold"] = """WITH RECURSIVE g AS (SELECT c_nationkey::VARCHAR AS nation, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey::VARCHAR) AS i FROM customer GROUP BY 1),
f AS (SELECT 0::BIGINT AS i, 0 AS fold, [0::BIGINT for x in range(least(5, (SELECT count(*) FROM g)))] AS load, NULL::VARCHAR AS nation, 0::BIGINT AS n
UNION ALL SELECT g.i, (list_position(load, list_min(load)) - 1)::INT, list_transform(load, lambda x, j: CASE WHEN j = list_position(load, list_min(load)) THEN x + g.n ELSE x END), g.nation, g.n FROM f JOIN g ON g.i = f.i + 1)
SELECT nation, fold, n FROM f WHERE nation IS NOT NULL"""


def market_rows(spark, d):
    """A row per customer segment and nation: features and a mean price."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").cast("string").alias("nation"), "c_mktsegment").agg(F.avg("o_totalprice").alias("price"), F.log1p(F.count("*")).alias("log_orders"), F.log1p(F.sum(F.greatest("c_acctbal", F.lit(0.0)))).alias("log_deposits"), F.count_distinct("o_custkey").cast("double").alias("customers"))


FEATURES = ("log_orders", "log_deposits", "customers")


def grouped_cv_forest(spark, d):
    rows = market_rows(spark, d)
    grid = {"n_trees": [20], "min_leaf": [2, 3], "max_features": [1.0]}
    fitted = learning.fit(rows, "market", FEATURES, "nation", "price", grid=grid)
    made = fitted.predict(rows.select("nation", "c_mktsegment", "price", *FEATURES))
    return made.select("nation", "c_mktsegment", F.round("predicted", 2).alias("predicted"), F.round(F.col("predicted") * F.exp(F.lit(fitted.metadata["residual_log_q10"])), 2).alias("low"), F.round(F.col("predicted") * F.exp(F.lit(fitted.metadata["residual_log_q90"])), 2).alias("high"))


QUERIES["grouped_cv_forest"] = grouped_cv_forest


def gbt_absolute(spark, d):
    rows = market_rows(spark, d)
    fitted = learning.fit(rows, "cell", FEATURES, "nation", "price", grid={"n_trees": [30], "leaves": [3, 5], "min_leaf": [2]})
    return fitted.predict(rows.select("nation", "c_mktsegment", "price", *FEATURES)).select("nation", "c_mktsegment", F.round("predicted", 2).alias("predicted"))


QUERIES["gbt_absolute"] = gbt_absolute


def labelled_cells(spark, d):
    """A labelled cell per nation and segment: the means of all its scored cells by their
    listings, which are summed. So every cell counts, and the rows do not grow with the table."""
    from .access import scored

    cells = scored(spark, d).withColumn("price", 1000 + F.greatest("c_acctbal", F.lit(0.0))).withColumn("n", (F.col("c_custkey") % 4 + 1).cast("double"))
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
    return cells.groupBy("nation", "c_mktsegment").agg(*(mean(f"norm_{c}").alias(f"norm_{c}") for c in COMPONENTS), mean("price").alias("price_per_sqm_php"), F.sum("n").alias("listing_observations"))


def simplex_weight_fit(spark, d):
    """Component weights learned from all labelled cells of the accessibility index."""
    found = learning.fit_weight_model(labelled_cells(spark, d), DEFAULTS["weight_model"])
    return spark.createDataFrame([(c, round(w, 4), found["minimum_weights"][c]) for c, w in found["weights"].items()], "component string, weight double, floor double")


QUERIES["simplex_weight_fit"] = simplex_weight_fit
