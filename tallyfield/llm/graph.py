"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import materialise


def starred(links: DataFrame) -> DataFrame:
    """The same components by fewer links (a, b), a < b.

    Each node keeps its smallest neighbour below it, and its other neighbours
    below it link to that one. Where many nodes have the same few hubs, a link
    a node and a few between hubs are left. A window holds the links of one
    node to smaller ones.
    """
    d = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    d = d.withColumn("lo", F.min("a").over(Window.partitionBy("b")))
    return d.select(F.col("lo").alias("a"), "b").union(d.filter("lo < a").select(F.col("lo").alias("a"), F.col("a").alias("b"))).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node and component, the smallest node that links (a, b) reach from it; a row for each node in a link.

    A round gives each node the smallest label around it and then the label of
    its label, so a path of length n takes about log n rounds. Minima are
    pre-aggregated and labels are one row a node, so a node with many links
    is no hot group. Ends when a round changes nothing.
    """
    links = starred(links)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both, label)
    now = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), label)
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = now.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        far = now.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        after = step.join(far, F.col("via") == F.col("_n")).select("node", F.least("via", "_c").alias("component"), (F.least("via", "_c") < F.col("old")).alias("moved"))
        after = materialise(after, label)
        now = after.select("node", "component")
        if after.filter("moved").isEmpty():
            return now
