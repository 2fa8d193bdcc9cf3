"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (a, root): every node that has a smaller node in its component, with
    the smallest.  Each round hangs the larger neighbours of every node on its smallest
    neighbour, then the smaller ones, until the links are stars.  All steps are joins and
    minima by node; nothing but whether it is done comes to the driver."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(links.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(
            "a", F.least("a", "_m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        # Stars: no node hangs on two others, and none that others hang on hangs itself.
        twice = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
        inner = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")
        if twice.union(inner).isEmpty():
            return edges.select("a", F.col("b").alias("root"))
