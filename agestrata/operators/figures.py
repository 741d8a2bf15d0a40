"""The data behind each figure: cuts of the stage tables, small by nature."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.config import CATEGORIES, DEFAULT, Settings
from agestrata.functions.temporal import midnight
from agestrata.operators import attract, projection
from agestrata.operators.balance import dense_bands, pyramid
from agestrata.operators.state import at_date, at_year


def pyramids_of(state: DataFrame, scopes: list[int], dates: list[date], settings: Settings = DEFAULT) -> DataFrame:
    """Frames of some scopes at some dates, filtered before anything is counted. Dates that the table doesn't have are an
    error; a scope without people at a date has no rows there."""
    cut = state.filter(F.col("scope_id").isin(*scopes) & F.col("snapshot").isin(*[midnight(d) for d in dates]))
    found = {r.snapshot.date() for r in cut.select("snapshot").distinct().collect()}
    if missing := [d for d in dates if d not in found]:
        at_date(state, *missing)
    return pyramid(cut, settings)


def grid_status(state: DataFrame, annual: DataFrame, scopes: list[int], day: date, settings: Settings = DEFAULT) -> DataFrame:
    """Frames of some scopes with their quadrant of the year."""
    own = at_year(annual, day.year).select("scope_id", "quadrant")
    return pyramids_of(state, scopes, [day], settings).join(own, "scope_id", "left")


def grid_types(state: DataFrame, metrics: DataFrame, scopes: list[int], day: date, settings: Settings = DEFAULT) -> DataFrame:
    """Frames of some scopes with their type."""
    return pyramids_of(state, scopes, [day], settings).join(at_date(metrics, day).select("scope_id", "type"), "scope_id", "left")


def grid_centered(state: DataFrame, metrics: DataFrame, scopes: list[int], day: date, settings: Settings = DEFAULT) -> DataFrame:
    """Frames of some scopes with both ratios and their type."""
    return pyramids_of(state, scopes, [day], settings).join(at_date(metrics, day).select("scope_id", "ccr", "ncr", "type"), "scope_id", "left")


def most_centered(metrics: DataFrame, day: date, many: int = 2) -> DataFrame:
    """The scopes whose ratios are nearest to zero (a top list)."""
    off = F.abs("ccr") + F.abs("ncr")
    return at_date(metrics, day).filter("type is not null").orderBy(off, "scope_id").limit(many).select("scope_id", "ccr", "ncr", "type")


def type_scatter(metrics: DataFrame, scopes: DataFrame, day: date) -> DataFrame:
    cut = at_date(metrics, day).filter("type is not null")
    return cut.join(scopes.select("scope_id", "label"), "scope_id", "left").select("scope_id", F.substring_index("label", "/", -1).alias("short_label"), "ccr", "ncr", "type")


def magnet_sticky(annual: DataFrame, scopes: DataFrame, year: int) -> DataFrame:
    """Points of the eligible scopes of a year; a year that the table doesn't have is an error."""
    cut = at_year(annual, year)
    return cut.filter("eligible").join(scopes.select("scope_id", "label"), "scope_id", "left").select("scope_id", "label", "magnetism", "stickiness", "quadrant")


def projection_overlay(table: DataFrame, scopes: list[int]) -> DataFrame:
    return table.filter(F.col("scope_id").isin(*scopes)).select("scope_id", "category", "band", "actual", "cohort_pred", "baseline_pred")


def projection_frame(table: DataFrame, column: str) -> DataFrame:
    """scope_id, band, then the sums of column by category, bands dense up to the scope's highest."""
    sums = table.filter(F.col("category").isin(*CATEGORIES)).groupBy("scope_id", "band").pivot("category", list(CATEGORIES)).agg(F.sum(column))
    filled = dense_bands(sums, ["scope_id"]).join(sums, ["scope_id", "band"], "left")
    return filled.select("scope_id", "band", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in CATEGORIES])


#: Figures by name: how each is read from the stage tables.
FIGURES: dict[str, Callable[..., DataFrame]] = {
    "pyramid-grid-status": lambda read, scopes, day, year: grid_status(read("state"), read("annual"), scopes, day),
    "pyramid-transition": lambda read, scopes, day, year: pyramids_of(read("state"), scopes, [day.replace(year=day.year - 1), day]),
    "type-scatter": lambda read, scopes, day, year: type_scatter(read("metrics"), read("scopes"), day),
    "pyramid-grid-types": lambda read, scopes, day, year: grid_types(read("state"), read("metrics"), scopes, day),
    "pyramid-grid-centered": lambda read, scopes, day, year: grid_centered(read("state"), read("metrics"), scopes or [r.scope_id for r in most_centered(read("metrics"), day).collect()], day),
    "pyramid-projection-overlay": lambda read, scopes, day, year: projection_overlay(read("projection"), scopes),
    "abre-table": lambda read, scopes, day, year: projection.error_table(read("projection")),
    "quadrant-table": lambda read, scopes, day, year: attract.grid_rows(attract.quadrant_grid(read("annual"))),
    "magnet-sticky": lambda read, scopes, day, year: magnet_sticky(read("annual"), read("scopes"), year),
    "pyramid-single": lambda read, scopes, day, year: pyramids_of(read("state"), scopes, [day]),
}
#: Figures of chosen scopes; without any they are left out of `all`.
OF_SCOPES = ("pyramid-grid-status", "pyramid-transition", "pyramid-grid-types", "pyramid-projection-overlay", "pyramid-single")


def data(read: Callable[[str], DataFrame], name: str | None, scopes: list[int], day: date, year: int) -> dict[str, DataFrame]:
    """A figure's data, or that of all; read gives a stage table by name."""
    if name is not None and name not in FIGURES:
        raise ValueError(f"no figure {name!r}; there are {', '.join(FIGURES)}")
    if name in OF_SCOPES and not scopes:
        raise ValueError(f"{name} is a figure of chosen scopes")
    names = [name] if name else [n for n in FIGURES if scopes or n not in OF_SCOPES]
    return {n: FIGURES[n](read, scopes, day, year) for n in names}


#: Figures of one point for each scope, of which some can be marked.
POINTS = ("type-scatter", "magnet-sticky")


def highlighted(points: DataFrame, scopes: list[int]) -> DataFrame:
    """points with highlighted: whether the point is of one of the scopes."""
    return points.withColumn("highlighted", F.col("scope_id").isin(*scopes))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A table as Markdown; rows beyond the limit, which bounds what a report holds, are counted."""
    rows = df.limit(limit + 1).collect()
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(text(v) for v in r) + " |" for r in rows[:limit]]]
    return "\n".join(lines + ([f"\n{df.count() - limit} more rows are left out."] if len(rows) > limit else []))
