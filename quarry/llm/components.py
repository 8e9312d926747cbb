"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def _summary(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """a (every node of a link), component (its smallest node). links: a, b of one orderable type.

    Large star: every node's larger neighbours go to its smallest neighbour. Small star: a node and its smaller neighbours go to
    the smallest of them. The smallest neighbour is an aggregate that combines before the shuffle, and the join with it can be split,
    so a node with a great many links is no single task. The links are written to the shared folder each round; the rounds
    grow with the logarithm of the longest path.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _summary(links)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links = written(small, "links")
        now = _summary(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return links.select("a", F.col("b").alias("component")).union(links.select(F.col("b").alias("a"), F.col("b").alias("component")).distinct())
