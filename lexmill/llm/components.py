"""Connected components of a table of links, by alternating large and small stars.

Each round lets every node hand its larger neighbours, then its smaller ones, to its least neighbour; after a few
rounds (at most the square of the logarithm of the nodes) only stars are left. Each half round is an aggregation, whose partial
minima are merged before the shuffle, and a join with the links; nothing is gathered per node and nothing leaves Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of the links (``a``, ``b``): the least node of its component. Values must not be null."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "cc-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc-small")
    nodes = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
