"""Connected components of a pair table, by alternating star contraction.

Every round hangs nodes onto smaller neighbours, first the larger ones, then the smaller ones, until
all that is left are stars around the smallest node of each component.  The number of rounds grows with
the logarithm of the data, also for long chains, and minima are pre-aggregated before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter("b > a").join(smallest, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the component is named after its smallest node."""
    edges = cut_lineage(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    seen = _digest(edges)
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
