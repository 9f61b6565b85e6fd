"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forget, written


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one edge, to a centre."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("centre").alias("centre")).where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("centre") > 0))).limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): the root is the component's least node.

    A step links each node's larger neighbours to the least one around (large star), then
    its smaller ones (small star): joins with pre-aggregated minima, written to the shared
    folder. No neighbourhood is gathered in a task, and steps grow with the logarithm of
    the size. All is done when only stars are left, as each centre is its star's least node.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, mid = written(large.where("a <> b").distinct(), "edges")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        step = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after, new = written(step.where("a <> b").distinct(), "edges")
        forget(spark, mid)
        forget(spark, path)
        now, path = after, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
