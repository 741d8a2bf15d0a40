"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.functions.lineage import discard, written


def components(links: DataFrame) -> DataFrame:
    """v, root for every end of links (a, b: of any type that has an order), root being the smallest v that can be reached.

    Each round hangs the larger (then the smaller) neighbours of every vertex below its least neighbour; it ends when
    every vertex hangs below its root. Minima are aggregated before the shuffle, so a vertex with very many links is no
    hot group; the links are joined back to them by sorting, where Spark splits skewed partitions and nothing is broadcast.
    """
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least.hint("merge"), "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        large = written(large, "large-star")
        below = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(below.hint("merge"), "v").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select(F.col("e.u").alias("v"), F.col("e.m").alias("u")).filter("v <> u").distinct()
        small = written(small, "small-star")
        discard(links, large)
        # done when no vertex has two parents and no parent has a parent
        tops = small.groupBy("v").count()
        if tops.filter("count > 1").isEmpty() and small.join(tops.select(F.col("v").alias("u")).hint("merge"), "u", "left_semi").isEmpty():
            return small.select("v", F.col("u").alias("root")).unionByName(small.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())
        links = small
