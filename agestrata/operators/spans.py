"""Activity spans: a contributor's events in a scope, cut where the gap is longer than the limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agestrata.config import DEFAULT, Settings
from agestrata.functions.temporal import DAY_US
from agestrata.schemas import conform

KEY = ("scope_id", "contributor_id")


def side(settings: Settings):
    return F.col("event_type").isin(*settings.types.coding)


def firsts(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """scope_id, contributor_id, init_c, init_d: first event on the coding side and on the other, over all history."""
    coding = side(settings)
    return events.groupBy(*KEY).agg(F.min(F.when(coding, F.col("timestamp"))).alias("init_c"), F.min(F.when(~coding, F.col("timestamp"))).alias("init_d"))


def activity_spans(events: DataFrame, settings: Settings = DEFAULT, tasks: int | None = None) -> DataFrame:
    """The spans table. A gap of exactly the limit keeps the span.

    Events of a day are within the limit of each other, so days with their first and last event tell as much. They are
    aggregated before the shuffle: a contributor with very many events has no more rows than days. All that follows is
    by scope and contributor, in one order of time, and stays where it is: a span is its last day, which knows the latest
    day that began one, so spans are a filter and no task holds a table of them.

    tasks: how many share it out, where that must be more than the session's number; the events are then dealt out by day,
    which parts a contributor with very many, and the days by contributor.
    """
    mine = Window.partitionBy(*KEY)
    in_time = mine.orderBy("last")
    so_far = in_time.rowsBetween(Window.unboundedPreceding, 0)
    coding, ts = side(settings), F.col("timestamp")
    dated = events.withColumn("day", F.floor(F.unix_micros("timestamp") / DAY_US))
    dated = dated.repartition(tasks, *KEY, "day") if tasks else dated
    days = dated.groupBy(*KEY, "day").agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.min(F.when(coding, ts)).alias("c"), F.min(F.when(~coding, ts)).alias("d")
    )
    days = days.repartition(tasks, *KEY) if tasks else days
    far = lambda later, earlier: F.coalesce(F.unix_micros(later) - F.unix_micros(earlier) > settings.gap_us, F.lit(True))
    marked = days.withColumns({"_starts": far(F.col("first"), F.lag("last").over(in_time)), "_ends": far(F.lead("first").over(in_time), F.col("last"))})
    marked = marked.select(
        *KEY, F.max(F.when(F.col("_starts"), F.col("first"))).over(so_far).alias("span_start"), F.col("last").alias("span_end"),
        (F.count_if("_starts").over(so_far) - 1).alias("span_idx"), F.min("c").over(mine).alias("init_c"), F.min("d").over(mine).alias("init_d"), "_ends",
    )
    return conform(marked.filter("_ends"), "spans")


def with_late(spans: DataFrame, late: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The spans of the contributors to whom late events belong, made anew from their spans and those events: what
    activity_spans gives of all their events, which needn't be read again. Other contributors' spans are as they were and
    not among the rows; late events that were there already change nothing.

    Late events are spans by themselves first, so that what meets a contributor's old spans is a row for each stretch.
    Spans that touch or overlap, or lie within the limit of each other, are one.
    """
    new = activity_spans(late, settings)
    columns = [*KEY, "span_start", "span_end", "init_c", "init_d"]
    old = spans.join(new.select(*KEY).distinct(), list(KEY), "left_semi")
    every = old.select(*columns).unionByName(new.select(*columns))
    mine = Window.partitionBy(*KEY)
    in_time = mine.orderBy("span_start", "span_end")
    reach = F.max(F.unix_micros("span_end")).over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    marked = every.withColumn("_new", F.coalesce((F.unix_micros("span_start") - reach > settings.gap_us).cast("int"), F.lit(0)))
    marked = marked.select(
        *KEY, "span_start", "span_end", F.sum("_new").over(in_time.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("span_idx"),
        F.min("init_c").over(mine).alias("init_c"), F.min("init_d").over(mine).alias("init_d"),
    )
    made = marked.groupBy(*KEY, "span_idx").agg(
        F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.first("init_c").alias("init_c"), F.first("init_d").alias("init_d")
    )
    return conform(made, "spans")


def span_summary(spans: DataFrame) -> DataFrame:
    """Per scope: contributors, those who ever coded, spans, and spans that are not their contributor's first."""
    people = spans.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("init_c").isNotNull().alias("coded"))
    return people.groupBy("scope_id").agg(
        F.count("*").alias("contributors"), F.count_if("coded").alias("ever_coded"), F.sum("n").alias("spans"), (F.sum("n") - F.count("*")).alias("later_spans")
    )


def scope_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("scope_id").agg(
        F.count("*").alias("events"), F.countDistinct("contributor_id").alias("contributors"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )


def side_counts(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return events.groupBy("scope_id").agg(F.count_if(side(settings)).alias("coding"), F.count_if(~side(settings)).alias("non_coding"))
