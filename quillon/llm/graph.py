"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of ``edges`` (a, b: long).
    Each round takes the least label among neighbours and then the label's own label, so
    the rounds grow with the logarithm of a component's diameter. Nothing but two counts
    goes to the driver; each round's labels are written, which ends the lineage."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("at")).agg(F.min("component").alias("near"))
        least = labels.join(near, F.col("node") == F.col("at")).select("node", F.least("component", "near").alias("least"), F.col("component").alias("was"))
        over = labels.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        fresh = least.join(over, F.col("least") == F.col("at")).select("node", F.least("least", "jump").alias("component"), (F.least("least", "jump") < F.col("was")).alias("changed"))
        fresh = materialise(fresh, "labels")
        labels = fresh.select("node", "component")
        if fresh.filter("changed").isEmpty():
            return labels
