"""Tables in the cluster's shared folder, and labels of connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialise

__all__ = ["components", "materialise"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest id reachable over ``edges`` (a, b), for every node that has an edge.

    Rounds of large-star and small-star: each node hands its neighbours to the smallest one. Every round is two groupings of the edge
    table (partial minima, no list of neighbours is gathered) and is written to the shared folder; the driver sees one count a round.
    """
    now = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        inner = after.select("v").intersect(after.select("u")).limit(1).count()
        twice = after.groupBy("u").count().filter("count > 1").limit(1).count()
        now = after
        if not inner and not twice:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
