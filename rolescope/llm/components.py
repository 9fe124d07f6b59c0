"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Ties the larger neighbours of each node to its smallest neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the smallest of them; links run from the larger node."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Node and the smallest node of its component, for the nodes that have links.

    ``links``: columns a, b of one integer type. Every round is a few joins and sums over
    the links, written to the shared folder; the links of a component end as a star. The
    driver sees a count and a checksum a round.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = stored(links, "links"), None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
        links = stored(_small_star(_large_star(links)), "links")
    tied = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
