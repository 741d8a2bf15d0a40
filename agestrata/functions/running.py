"""Running sums over a whole table in order, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agestrata.functions.lineage import written


def sum_before(table: DataFrame, keys: list[str], order: str, value: str, name: str = "below") -> DataFrame:
    """table with name: the sum of value over the rows of the same keys that come earlier by order (which ties don't
    have). Ranges of (keys, order) are shared out over tasks; one sum of each range and key is carried to later ranges."""
    dealt = written(table.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_carried", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(totals, [*keys, "_range"]).withColumn(name, F.col("_own") + F.col("_carried")).drop("_range", "_own", "_carried")


def medians(table: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys (none null), name: the exact median of value, nulls left out, NaN above all; a group of nulls has no row. Equal
    values are counted before the shuffle, and the one or two in the middle are found by running counts over ranges of
    value, so a group of any size is shared out over tasks."""
    counts = table.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_t"))
    below = sum_before(counts, keys, value, "_t", "_below")
    sizes = below.groupBy(*keys).agg(F.sum("_t").alias("_n"))
    placed = below.join(sizes, keys) if keys else below.crossJoin(sizes)  # one row
    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    middle = placed.filter((F.col("_below") <= high) & (F.col("_below") + F.col("_t") > low))
    a, b = F.min(value).cast("double"), F.max(value).cast("double")
    return middle.groupBy(*keys).agg(F.when(a == b, a).otherwise(a / 2 + b / 2).alias(name))
