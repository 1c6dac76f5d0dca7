"""Connected components of a graph whose edges are rows, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the undirected ``edges`` (a, b).

    Each round takes the smallest label among neighbours and then the label of that label; labels are a written table,
    so a lost executor costs one round. All steps are aggregations and joins on node ids; a hub's many edges are
    combined before the shuffle.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        best = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        near = labels.join(best, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = materialise(near.join(jump, "component").select("node", "old", F.least("component", "root").alias("component")))
        changed = after.filter("component <> old").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
