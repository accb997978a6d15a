"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.util import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "c"), F.col("a") == F.col("c")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (longs a, b); the component is its smallest node.

    Minima are partial aggregates, so a hot node sends one row a task; each round is a table in the shared folder, and the one
    before is deleted.  The
    number of rounds is about the logarithm of the longest chain; only a count and a checksum reach the driver.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (state := _state(now)) != before:
        before, last = state, now
        now = stored(_small_star(_large_star(last)), "links")
        discard(last)
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
