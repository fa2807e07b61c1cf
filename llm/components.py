"""Connected components of a graph given as links, by alternating stars.

Each round points every node at the least neighbour it has or its neighbours have, until nothing
changes; the number of rounds grows with the logarithm of the longest path. Rounds are joins and
minima over links, written in between, so neither nodes nor links meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.scratch import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    onward = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return onward.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node reached) of every node of ``links`` (a, b), roots included.

    Links of a node to itself keep the node. Nulls are ignored.
    """
    named = links.where("a is not null and b is not null")
    now = materialize(
        named.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = None
    for _ in range(most_rounds):
        now = materialize(_small_star(_large_star(now)).where("a != b").distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    own = named.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    alone = own.distinct().join(stars.unionByName(roots).select("node").distinct(), "node", "left_anti")
    return stars.unionByName(roots.distinct()).unionByName(alone)
