"""Pyramid frames, balance ratios and types."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agestrata.config import CATEGORIES, DEFAULT, MONTH_DAYS, Settings
from agestrata.operators.state import at_date
from agestrata.schemas import conform


def drawn(state: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The population of a figure: all (stock), or those with an event within the window (active)."""
    if settings.pyramid_population == "stock":
        return state
    return state.filter(F.col("idle_days") <= settings.pyramid_window_months * MONTH_DAYS)


def dense_bands(frame: DataFrame, keys: list[str], top: DataFrame | None = None) -> DataFrame:
    """keys and band from 0 to the highest band of the keys' rows (or of top, one row `band`), each once."""
    if top is None:
        return frame.groupBy(*keys).agg(F.max("band").alias("_top")).select(*keys, F.explode(F.sequence(F.lit(0), "_top")).alias("band"))
    return frame.select(*keys).distinct().crossJoin(F.broadcast(top.select(F.col("band").alias("_top")))).select(*keys, F.explode(F.sequence(F.lit(0), "_top")).alias("band"))


def pyramid(state: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """scope_id, snapshot, band, then a count for each category; bands are dense within each scope and snapshot."""
    keys = ["scope_id", "snapshot"]
    counts = drawn(state, settings).groupBy(*keys, "band").agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    # a scope and snapshot has as many rows as bands, which the years bound; so the state is read once, with no join
    listed = counts.groupBy(*keys).agg(F.max("band").alias("_top"), F.map_from_entries(F.collect_list(F.struct("band", F.struct(*CATEGORIES)))).alias("_of"))
    filled = listed.select(*keys, "_of", F.explode(F.sequence(F.lit(0), "_top")).alias("band"))
    return filled.select(*keys, "band", *[F.coalesce(F.col("_of")[F.col("band")][c], F.lit(0)).cast("long").alias(c) for c in CATEGORIES])


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / max(a, b), undefined where both are 0."""
    return F.try_divide((a - b).cast("double"), F.greatest(a, b).cast("double"))


def balance_type(ccr: Column, ncr: Column) -> Column:
    """A (+, +), B (CCR low, NCR high), C (high, low), D; zero is low."""
    up, young = ccr > 0, ncr > 0
    return F.when(ccr.isNull() | ncr.isNull(), None).when(up & young, "A").when(~up & young, "B").when(up, "C").otherwise("D")


def metrics(state: DataFrame) -> DataFrame:
    """The metrics table, over active contributors; a scope with none at a snapshot has no row."""
    coding = F.col("category") != "non_coding"
    m = state.filter("active").groupBy("scope_id", "snapshot").agg(
        F.count_if(coding).alias("coding"), F.count_if(~coding).alias("non_coding"), F.count_if(F.col("band") == 0).alias("new"), F.count_if(F.col("band") > 0).alias("experienced"), F.count("*").alias("total")
    )
    m = m.withColumn("ccr", ratio(F.col("coding"), F.col("non_coding"))).withColumn("ncr", ratio(F.col("new"), F.col("experienced")))
    return conform(m.withColumn("type", balance_type(F.col("ccr"), F.col("ncr"))), "metrics")


def type_table(metrics_: DataFrame, scopes: DataFrame, day: date) -> DataFrame:
    """Metrics of one snapshot with labels; order by type, then label, undefined types last."""
    cut = at_date(metrics_, day)
    out = cut.join(scopes.select("scope_id", "label"), "scope_id", "left").withColumn("label", F.coalesce("label", F.col("scope_id").cast("string")))
    return out.select("scope_id", "label", "coding", "non_coding", "new", "experienced", "total", "ccr", "ncr", "type")


def type_counts(metrics_: DataFrame, scopes: DataFrame, day: date) -> DataFrame:
    """type, scopes; scopes without a row at the snapshot or without a type count as unclassified."""
    cut = at_date(metrics_, day).select("scope_id", "type")
    every = scopes.select("scope_id").join(cut, "scope_id", "left")
    return every.groupBy(F.coalesce("type", F.lit("unclassified")).alias("type")).agg(F.count("*").alias("scopes"))


def by_attribute(events: DataFrame, scopes: DataFrame, attribute: str = "language") -> DataFrame:
    """Events whose scope is the attribute's value, as a stable number, with value: a unit of analysis like any other."""
    values = scopes.select("scope_id", F.col(attribute).alias("value")).filter("value is not null")
    return events.join(values, "scope_id").select(F.xxhash64("value").alias("scope_id"), "contributor_id", "event_type", "timestamp", "value")
