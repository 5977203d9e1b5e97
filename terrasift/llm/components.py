"""Connected components by rounds of joins: smallest label of the neighbours, then of the label itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in the links (a, b); component is the smallest
    id that its links reach.

    A round joins links and labels, so a node with very many links is dealt like
    any other skewed join, and takes one partial aggregate. Following the label's
    own label halves the way that is left; a round's result is written to shared
    storage, which cuts the lineage.
    """
    a, b = F.col("a"), F.col("b")
    there = edges.where(a != b).select(a.cast("long").alias("a"), b.cast("long").alias("b"))
    both = keep(there.union(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy(a.alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(a.alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        jump = labels.select(F.col("id").alias("step"), F.col("component").alias("far"))
        new = keep(step.join(jump, "step").select("id", "old", F.least("step", "far").alias("component")))
        labels = new.select("id", "component")
        if new.where(F.col("old") != F.col("component")).isEmpty():
            return labels
