"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.plans.storage import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. ``edges`` has a > b; every node of a neighbourhood is tied to its smallest member."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    out = tied.where(F.col("b") > F.col("a")) if large else tied.where(F.col("b") != F.col("m"))
    out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Null ends and loops are ignored. The number of rounds is logarithmic in the longest path; each is cut by a
    checkpoint, and only two numbers a round reach the driver.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(ends.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = _print(now)
    while seen[0]:
        now = cut(_star(_star(now, True), False))
        found = _print(now)
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
