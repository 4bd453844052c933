"""Connected components of a graph given as links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import staged


def _state(links: DataFrame) -> tuple:
    """Number of links and a sum over them that does not depend on their order."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours move to the smallest neighbour."""
    both = links.unionByName(links.select(F.col("a").alias("b"), F.col("b").alias("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that has a link.

    links: integer columns ``a`` and ``b``; order, repeats and self links do not matter. Nodes are only
    aggregated and joined, never listed per group. Each round is written to the shared folder.
    """
    plain = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(plain, name)
    state = _state(now)
    while state[0]:
        now = staged(_small_star(_large_star(now)), name)
        before, state = state, _state(now)
        if state == before:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
