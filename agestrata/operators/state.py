"""The state of every contributor at each snapshot."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agestrata.config import DEFAULT, MONTH_DAYS, Settings
from agestrata.functions.lineage import written
from agestrata.functions.temporal import days_between, midnight, quarter_ends
from agestrata.operators.spans import KEY
from agestrata.schemas import conform


def state_at(spans: DataFrame, dates: list[date] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The state table: a row for each contributor, scope and snapshot that a span starts by.

    The last event at T is the latest span end, cut at T, so inside a span it is T itself. A contributor is coding from
    the first coding event on, moved if one of the other kind came before it. Bands are closed at the top. The dates are
    a literal of the plan and a span meets those from its start to before the next span's, with no join and no
    aggregation: rows pass one by one, partitioned and ordered as the spans are. Spans of a contributor don't overlap.
    """
    dates = quarter_ends(settings.start, settings.end, settings.freq_months) if dates is None else dates
    if not dates:
        raise ValueError("no snapshot dates")
    every = F.array(*[F.lit(datetime(d.year, d.month, d.day)).cast("timestamp") for d in dates])
    in_time = Window.partitionBy(*KEY).orderBy("span_end")
    until, coded = F.least("span_end", "snapshot"), F.col("init_c").isNotNull() & (F.col("init_c") <= F.col("snapshot"))
    part = lambda end, first: F.greatest(days_between(end, F.greatest("span_start", first)), F.lit(0.0))
    told = {"_next": F.lead("span_start").over(in_time)}
    if settings.age_basis == "accumulated_active":
        earlier = in_time.rowsBetween(Window.unboundedPreceding, -1)
        told |= {f"_worked_{c}": F.coalesce(F.sum(part(F.col("span_end"), F.col(c))).over(earlier), F.lit(0.0)) for c in ("init_c", "init_d")}
    timed = spans.withColumns(told)
    seen = F.filter(every, lambda t: (t >= F.col("span_start")) & (F.col("_next").isNull() | (t < F.col("_next"))))
    at = timed.withColumn("snapshot", F.explode(seen)).withColumn("last", until)
    at = at.withColumn("_coded", coded)
    moved = F.coalesce(F.col("init_d") < F.col("init_c"), F.lit(False))
    at = at.withColumn("category", F.when(F.col("_coded") & moved, "moved").when(F.col("_coded"), "coding").otherwise("non_coding"))
    origin = F.when(F.col("_coded"), F.col("init_c")).otherwise(F.col("init_d"))
    if settings.age_basis == "calendar_tenure":
        age = days_between(F.col("snapshot"), origin)
    else:
        age = F.when(F.col("_coded"), F.col("_worked_init_c")).otherwise(F.col("_worked_init_d")) + part(F.col("last"), origin)
    at = at.withColumn("age_days", F.greatest(age, F.lit(0.0)))
    at = at.withColumn("age_months", F.col("age_days") / MONTH_DAYS).withColumn("idle_days", days_between(F.col("snapshot"), F.col("last")))
    at = at.withColumn("band", F.greatest(F.ceil(F.round(F.col("age_days") / float(settings.band_days), 9)) - 1, F.lit(0)))
    return conform(at.withColumn("active", F.col("idle_days") <= settings.gap_days), "state")


def at_date(table: DataFrame, *days: date) -> DataFrame:
    """The rows of some snapshots; a date that the table doesn't have is an error, never an empty result. The cut is
    stored, so that looking whether it is empty doesn't compute it twice."""
    cut = written(table.filter(F.col("snapshot").isin(*[midnight(d) for d in days])), "cut")
    found = {r.snapshot.date() for r in cut.select("snapshot").distinct().collect()}
    if missing := [str(d) for d in days if d not in found]:
        known = [str(r.snapshot.date()) for r in table.select("snapshot").distinct().orderBy("snapshot").collect()]
        raise ValueError(f"no snapshot {', '.join(missing)}; there are {', '.join(known) or 'none'}")
    return cut


def at_year(annual: DataFrame, year: int) -> DataFrame:
    """The rows of a year; a year that the table doesn't have is an error."""
    cut = written(annual.filter(F.col("year") == year), "cut")
    if cut.isEmpty():
        known = sorted(r.year for r in annual.select("year").distinct().collect())
        raise ValueError(f"no year {year}; there are {known}")
    return cut
