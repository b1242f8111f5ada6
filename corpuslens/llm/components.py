"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for each node of links(a, b), both of one orderable type.

    Each round hooks every node to the least label around it and then follows labels once more, so
    that paths halve; a hub's labels combine before they are shuffled. Every round is a table, and
    rounds go on until no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(~F.col("a").eqNullSafe(F.col("b")))
    edges = written(both.distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(around, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        hooked = written(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = written(hooked.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "was"), "labels")
        if not labels.where("component != was").take(1):
            return labels.select("node", "component")
