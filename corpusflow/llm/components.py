"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_as_table


def _stars(edges: DataFrame) -> bool:
    """Does every node hang on one node that hangs on none?"""
    more = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    inner = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
    return not more.unionByName(inner).limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(a, b) undirected links of comparable ids -> (node, root): every linked node with the least id
    that it reaches. Nulls and self-links are ignored.

    Each step hangs a node's neighbours on their common minimum; the number of rounds grows with the
    logarithm of a component's size. Minima are partial aggregates, so a node with many links is
    combined before the shuffle, and the join that brings them back is one that adaptive execution
    can split. Every round is written to the shared checkpoint folder."""
    edges = keep_as_table(links.filter(F.col("a") != F.col("b"))
                          .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = keep_as_table(both.join(low, "a").filter(F.col("b") > F.col("a"))
                              .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        edges = keep_as_table(small, "cc-small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
