"""Connected components of a large link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalangu.session import through_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another; root is the smallest node reachable.

    Links may be repeated, in either direction, or from a node to itself; rows
    with a null end are ignored. Each round points the larger neighbours of a
    node at the smallest one, then does the same for the smaller neighbours;
    a node's links meet in joins and minima only, so no neighbourhood is
    gathered, and the number of rounds grows with the logarithm of the longest
    chain. Every round is written to the shared folder, so a lost executor
    costs a part of one round. Only a count and a checksum reach the driver.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = through_table(edges, "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("m", F.explode(F.array("a", "b")).alias("x"))
        edges = through_table(small.filter(F.col("x") != F.col("m")).select(
            F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "links")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
