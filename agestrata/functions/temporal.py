"""Time arithmetic on integer microseconds, and the series of snapshot dates."""

from __future__ import annotations

import calendar
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000.0


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY_US)


def quarter_ends(start: date, end: date, months: int = 3) -> list[date]:
    """Month ends from start's month to end, every so many months: the last day of each month, never day 30 carried on."""
    out, k = [], start.year * 12 + start.month - 1
    while True:
        y, m = divmod(k, 12)
        d = date(y, m + 1, calendar.monthrange(y, m + 1)[1])
        if d > end:
            return out
        out.append(d)
        k += months


def anchors(dates: list[date]) -> tuple[date, date, date]:
    """(first base, second base, target): the last three dates, the target being the classification snapshot too."""
    if len(dates) < 3:
        raise ValueError(f"a window needs three snapshots at least, not {len(dates)}")
    return dates[-3], dates[-2], dates[-1]


def anchors_of(settings, dates: list[date]) -> tuple[date, date, date]:
    """The anchors of the settings, which must be dates of the series, or its last three."""
    if settings.anchors is None:
        return anchors(dates)
    if missing := [str(d) for d in settings.anchors if d not in dates]:
        raise ValueError(f"no snapshot {', '.join(missing)}; the last are {', '.join(map(str, dates[-6:]))}")
    return settings.anchors


def snapshot_dates(spark: SparkSession, start: date, end: date, months: int = 3) -> DataFrame:
    """snapshot (midnight), a row for each date of the series."""
    firsts = F.sequence(F.trunc(F.lit(start), "month"), F.trunc(F.lit(end), "month"), F.expr(f"interval {months} months"))
    return spark.range(1).select(F.explode(firsts).alias("d")).select(F.last_day("d").cast("timestamp").alias("snapshot")).filter(F.col("snapshot") <= F.lit(end).cast("timestamp"))


def midnight(d: date) -> Column:
    return F.lit(datetime(d.year, d.month, d.day)).cast("timestamp")
