"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted


def _stars(pairs: DataFrame, n: int) -> DataFrame:
    """Of ``n`` directed rows (u, v): each row with m, the least of u and of all that u points to.

    The minima are made before the shuffle in part, so a hot node is one row of each task. Its links
    don't meet in a task either, for its minimum is sent to where they lie.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    return join_counted(pairs, least.withColumn("m", F.least("u", "m")), "u", n)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: of every node that has a link to another one, the least node that it reaches.

    Links are undirected; repeated ones, links of a node to itself and those with a null end change
    nothing. No node's links are gathered: each round is two minima by node, joined back to the
    links, and a hot node's links stay where they are. The rounds end when the links are stars, after
    about the logarithm of the longest path.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, 2 * seen[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(large, seen[0])  # of a link at most one side is larger, so these are no more than the links
        edges = cut(small.select("u", F.col("m").alias("v")).unionByName(small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
