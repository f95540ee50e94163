"""Connected components over links, by alternating large-star and small-star steps.

Every round is a few joins and aggregations whose output is written to the
shared folder; a node's links are never gathered in one row, and nothing but
one checksum a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_with_hot, materialize


#: With more links than this, nodes that have more than this share of them are broadcast, not shuffled.
MANY, HOT = 1_000_000, 1 / 1000


def _with_least(e: DataFrame, least: DataFrame, links: int) -> DataFrame:
    return e.join(least.drop("n"), "u") if links <= MANY else join_with_hot(e, least, "u", "n", links * HOT)


def _large_star(e: DataFrame, links: int) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both, least, links).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, links: int) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(e, least, links).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``root`` (the smallest id reachable) of every node that has a link to another.

    Links of a node to itself and repeated links don't matter; links with a
    null end are no links. No links give an empty table.
    """
    ends = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = materialize(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*ends).distinct())
    before = _sum(edges)
    while before[0]:
        new = materialize(_small_star(_large_star(edges, before[0]), before[0]))
        discard(edges)
        edges, after = new, _sum(new)
        if after == before:
            break
        before = after
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return found.union(found.select(F.col("root").alias("id"), "root").distinct())
