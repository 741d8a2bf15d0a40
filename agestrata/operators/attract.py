"""Attraction and retention of contributors by year, with quadrants split at the median."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agestrata.config import CODING, DEFAULT, Settings
from agestrata.functions.lineage import written
from agestrata.functions.running import medians
from agestrata.operators.state import at_year
from agestrata.schemas import conform

# Quadrants by (magnetism, stickiness) above the median.
QUADRANTS = {(True, True): "attractive", (True, False): "floating", (False, True): "stagnant", (False, False): "terminal"}


def dev_years(events: DataFrame, types: tuple[str, ...] | None = CODING) -> DataFrame:
    """scope_id, contributor_id, year of the events of these types (None: all), each once."""
    kept = events if types is None else events.filter(F.col("event_type").isin(*types))
    return conform(kept.select("scope_id", "contributor_id", F.year("timestamp").alias("year")).distinct(), "dev_years")


def _with_first(pairs: DataFrame, first: str, debut: DataFrame | None = None) -> DataFrame:
    """pairs with is_new: in the person's first year anywhere (global), in this scope (local), or by a table of first
    years (contributor_id, first_year)."""
    if debut is not None:
        return pairs.join(debut, "contributor_id", "left").withColumn("is_new", F.coalesce(F.col("year") == F.col("first_year"), F.lit(False))).drop("first_year")
    keys = ("contributor_id",) if first == "global" else ("scope_id", "contributor_id")
    return pairs.withColumn("is_new", F.col("year") == F.min("year").over(Window.partitionBy(*keys)))


def newcomers(pairs: DataFrame) -> DataFrame:
    """Per scope and year: devs, newcomers_here, and newcomers_total, people new anywhere that year."""
    new = _with_first(pairs, "global")
    here = new.groupBy("scope_id", "year").agg(F.count("*").alias("devs"), F.count_if("is_new").alias("newcomers_here"))
    total = new.filter("is_new").groupBy("year").agg(F.countDistinct("contributor_id").alias("newcomers_total"))
    return here.join(total, "year", "left").select("scope_id", "year", "devs", "newcomers_here", F.coalesce("newcomers_total", F.lit(0)).alias("newcomers_total"))


def retained(pairs: DataFrame, scope: str = "project") -> DataFrame:
    """pairs with stayed: the person is there in exactly the next year, in the same scope (project) or anywhere (dataset)."""
    if scope == "project":
        nxt = F.lead("year").over(Window.partitionBy("scope_id", "contributor_id").orderBy("year"))
        return pairs.withColumn("stayed", F.coalesce(nxt == F.col("year") + 1, F.lit(False)))
    later = pairs.select("contributor_id", (F.col("year") - 1).alias("year")).distinct().withColumn("stayed", F.lit(True))
    return pairs.join(later, ["contributor_id", "year"], "left").withColumn("stayed", F.coalesce("stayed", F.lit(False)))


def annual(pairs: DataFrame, settings: Settings = DEFAULT, first: str = "global", debut: DataFrame | None = None, ties: str = "low") -> DataFrame:
    """The annual table. The last year has no next one, so no stickiness; the first is only flagged. Eligible scopes have
    more people than the limit and both ratios; medians are over them, and high is above the median (ties='high': or on it)."""
    new = retained(_with_first(pairs, first, debut), settings.stickiness_scope)
    per = new.groupBy("scope_id", "year").agg(F.count("*").alias("devs"), F.count_if("is_new").alias("newcomers_here"), F.count_if("stayed").alias("retained"))
    who = "contributor_id" if first == "global" else F.struct("scope_id", "contributor_id")
    total = new.filter("is_new").groupBy("year").agg(F.countDistinct(who).alias("newcomers_total"))
    ends = pairs.agg(F.min("year").alias("_min"), F.max("year").alias("_max"))
    # years and one row of their ends: a few rows whatever the input
    per = per.join(F.broadcast(total), "year", "left").crossJoin(F.broadcast(ends)).withColumn("newcomers_total", F.coalesce("newcomers_total", F.lit(0)))
    per = per.withColumn("left_censored", F.col("year") == F.col("_min")).withColumn("right_censored", F.col("year") == F.col("_max"))
    per = per.withColumn("magnetism", F.try_divide(F.col("newcomers_here").cast("double"), F.col("newcomers_total").cast("double")))
    per = per.withColumn("stickiness", F.when(~F.col("right_censored"), F.try_divide(F.col("retained").cast("double"), F.col("devs").cast("double"))))
    per = per.withColumn("eligible", (F.col("devs") > settings.min_active_devs) & F.col("magnetism").isNotNull() & F.col("stickiness").isNotNull())
    per = written(per, "annual")  # medians, labels and whatever is made of the result start from it
    for ratio in ("magnetism", "stickiness"):
        per = per.join(F.broadcast(medians(per.filter("eligible"), ["year"], ratio, f"median_{ratio}")), "year", "left")
    high = (lambda c, m: F.col(c) >= F.col(m)) if ties == "high" else (lambda c, m: F.col(c) > F.col(m))
    magnet, sticky = high("magnetism", "median_magnetism"), high("stickiness", "median_stickiness")
    quadrant = F.when(~F.col("eligible"), None)
    for (m, s), name in QUADRANTS.items():
        quadrant = quadrant.when((magnet if m else ~magnet) & (sticky if s else ~sticky), name)
    return conform(per.withColumn("quadrant", quadrant), "annual")


def quadrant_counts(annual_: DataFrame) -> DataFrame:
    return annual_.groupBy("year", "quadrant").agg(F.count("*").alias("scopes"), F.first("median_magnetism").alias("median_magnetism"), F.first("median_stickiness").alias("median_stickiness"))


def quadrant_grid(annual_: DataFrame) -> DataFrame:
    """scope_id, year, mark for every scope and year: the quadrant's first letter, * if ineligible, - without activity."""
    ends = annual_.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    spine = annual_.select("scope_id").distinct().crossJoin(F.broadcast(ends)).select("scope_id", F.explode(F.sequence("a", "b")).alias("year"))
    mark = F.when(F.col("eligible").isNull(), "-").when(~F.col("eligible"), "*").otherwise(F.upper(F.substring("quadrant", 1, 1)))
    return spine.join(annual_.select("scope_id", "year", "eligible", "quadrant"), ["scope_id", "year"], "left").select("scope_id", "year", mark.alias("mark"))


def year_table(annual_: DataFrame, scopes: DataFrame, year: int) -> DataFrame:
    """The eligible scopes of a year with their labels; a year that the table doesn't have is an error."""
    cut = at_year(annual_, year).filter("eligible").join(scopes.select("scope_id", "label"), "scope_id", "left")
    return cut.select("scope_id", F.coalesce("label", F.col("scope_id").cast("string")).alias("label"), "quadrant", "magnetism", "stickiness", "devs", "newcomers_here")


def grid_rows(grid: DataFrame) -> DataFrame:
    """scope_id, first (year), marks: the marks of a scope's years as one word."""
    row = grid.groupBy("scope_id").agg(F.min("year").alias("first"), F.array_sort(F.collect_list(F.struct("year", "mark"))).alias("of"))
    return row.select("scope_id", "first", F.array_join(F.transform("of", lambda x: x["mark"]), "").alias("marks"))


def grid_cells(rows: DataFrame) -> DataFrame:
    """The grid again from its rows."""
    cells = rows.select("scope_id", "first", F.posexplode(F.filter(F.split("marks", ""), lambda x: x != "")).alias("at", "mark"))
    return cells.select("scope_id", (F.col("first") + F.col("at")).cast("int").alias("year"), "mark")
