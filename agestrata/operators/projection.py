"""Cohort projection of the next snapshot from two earlier ones, against repeating the last, with balanced errors."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agestrata.config import CATEGORIES, DEFAULT, Settings
from agestrata.functions.lineage import written
from agestrata.functions.running import medians, sum_before
from agestrata.functions.stats import signed_rank_z, signs_p, two_sided
from agestrata.functions.temporal import midnight
from agestrata.operators.balance import dense_bands
from agestrata.operators.state import at_date
from agestrata.schemas import conform

SERIES = (*CATEGORIES, "all")
METHODS = ("cohort", "baseline")


def eligible(state: DataFrame, base: date, settings: Settings = DEFAULT) -> DataFrame:
    """scope_id, contributors: scopes with more people than the limit at the first base date."""
    at = at_date(state, base)
    at = at.filter("active") if settings.min_contributors_basis == "active" else at
    # at one snapshot a person has one row, so no task needs a table of them
    return at.groupBy("scope_id").agg(F.count("contributor_id").alias("contributors")).filter(F.col("contributors") > settings.min_contributors)


def band_vectors(state: DataFrame, dates: tuple[date, date, date], settings: Settings = DEFAULT) -> DataFrame:
    """scope_id, category (also all), band, base, last, actual: active people of eligible scopes. Bands reach to the
    highest of any row at the three dates, active or not, of any scope."""
    three = state.filter(F.col("snapshot").isin(*[midnight(d) for d in dates]))
    top = three.agg(F.coalesce(F.max("band"), F.lit(0)).alias("band"))
    kept = eligible(state, dates[0], settings).select("scope_id")
    at = [F.col("snapshot") == midnight(d) for d in dates]
    own = three.filter("active").join(kept, "scope_id", "left_semi")
    counts = own.groupBy("scope_id", "category", "band").agg(*[F.count_if(c).alias(n) for c, n in zip(at, ("base", "last", "actual"), strict=True)])
    counts = counts.withColumn("category", F.explode(F.array("category", F.lit("all")))).groupBy("scope_id", "category", "band").agg(*[F.sum(n).alias(n) for n in ("base", "last", "actual")])
    names = kept.select("scope_id", F.explode(F.array(*map(F.lit, SERIES))).alias("category"))
    spine = dense_bands(names, ["scope_id", "category"], top)
    return spine.join(counts, ["scope_id", "category", "band"], "left").select("scope_id", "category", "band", *[F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in ("base", "last", "actual")])


def cohort_projection(vectors: DataFrame) -> DataFrame:
    """vectors with cohort_pred and orphan. pred[b] = last[b] / base[b-1] * last[b-1]; undefined (orphan) where base[b-1]
    is 0 and last[b] isn't; the first band is the mean of the two."""
    w = Window.partitionBy("scope_id", "category").orderBy("band")
    low_base, low_last = F.lag("base").over(w), F.lag("last").over(w)
    v = vectors.withColumn("_b", low_base).withColumn("_l", low_last)
    orphan = (F.col("band") > 0) & (F.col("_b") == 0) & (F.col("last") > 0)
    pred = F.when(F.col("band") == 0, (F.col("last") + F.col("base")) / 2).when(orphan, None).when(F.col("_b") == 0, 0.0).otherwise(F.try_divide(F.col("last"), F.col("_b")) * F.col("_l"))
    return v.withColumn("orphan", orphan).withColumn("cohort_pred", pred).drop("_b", "_l")


def orphans(projected: DataFrame) -> DataFrame:
    return projected.filter("category <> 'all'").groupBy("category").agg(F.count_if("orphan").alias("orphans"))


def abre(actual: Column, pred: Column) -> Column:
    """|p - a| / min(a, p); undefined if either is, or if the lesser is 0; a negative side is an error."""
    low = F.least(actual, pred)
    checked = F.when(low < 0, F.raise_error(F.lit("a balanced error of a negative number"))).otherwise(low)
    return F.when(actual.isNotNull() & pred.isNotNull(), F.try_divide(F.abs(pred - actual), checked.cast("double")))


def mre(actual: Column, pred: Column) -> Column:
    return F.try_divide(F.abs(pred - actual), actual)


def mer(actual: Column, pred: Column) -> Column:
    return F.try_divide(F.abs(pred - actual), pred)


def errors(projected: DataFrame, types: DataFrame) -> DataFrame:
    """The projection table. Cells are left out where the actual count is 0, or both predictions are."""
    a, c, b = F.col("actual"), F.col("cohort_pred"), F.col("baseline_pred")
    out = projected.withColumn("baseline_pred", F.col("last")).join(types.select("scope_id", "type"), "scope_id", "left")
    out = out.filter(~((a == 0) | (F.coalesce(c == 0, F.lit(False)) & (b == 0))))
    return conform(out.withColumn("abre_cohort", abre(a, c)).withColumn("abre_baseline", abre(a, b)), "projection")


def _by_type(pairs: DataFrame) -> DataFrame:
    """Each row under its type and under All types; rows without a type only under the latter."""
    return pairs.withColumn("type", F.explode(F.array_compact(F.array("type", F.lit("All types")))))


def complete(table: DataFrame) -> DataFrame:
    return table.filter("abre_cohort is not null and abre_baseline is not null")


def error_table(table: DataFrame) -> DataFrame:
    """type, projects, pairs, then the median errors of each series by both methods, over complete pairs."""
    pairs = _by_type(written(complete(table), "pairs"))
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"abre_{m}").alias("x")) for m in METHODS])).alias("of")
    middle = medians(pairs.select("type", "category", methods).select("type", "category", "of.*"), ["type", "category", "method"], "x")
    cell = lambda c, m: F.max(F.when((F.col("category") == c) & (F.col("method") == m), F.col("median"))).alias(f"{c}_{m}")
    cells = middle.groupBy("type").agg(*[cell(c, m) for c in SERIES for m in METHODS])
    sizes = pairs.groupBy("type").agg(F.countDistinct("scope_id").alias("projects"), F.count_if(F.col("category") == "all").alias("pairs"))
    return sizes.join(cells, "type")


def _ranked(table: DataFrame) -> DataFrame:
    """type, category, size, t, up, far, rank: the different sizes of paired differences (0 included, with rank 0), how
    many have each, how many of them are positive, and their mean rank. Equal differences are aggregated first, so a rank
    is a running sum over distinct values."""
    d = F.col("abre_cohort") - F.col("abre_baseline")
    pairs = _by_type(complete(table)).withColumn("d", d).withColumn("far", F.abs(d) > 1e-8 + 1e-5 * F.abs("abre_baseline"))
    keys = ["type", "category"]
    values = pairs.groupBy(*keys, F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"), F.count_if("far").alias("far"))
    nonzero = F.col("size") > 0
    ranked = sum_before(values.withColumn("_t", F.when(nonzero, F.col("t")).otherwise(0)), keys, "size", "_t")
    return ranked.withColumn("rank", F.when(nonzero, F.col("below") + (F.col("t") + 1) / 2).otherwise(0.0))


def _statistics(ranked: DataFrame) -> DataFrame:
    nonzero = F.col("size") > 0
    t = F.when(nonzero, F.col("t")).otherwise(0)
    return ranked.groupBy("type", "category").agg(
        F.sum(t).alias("n"), F.sum(F.when(nonzero, 0).otherwise(F.col("t"))).cast("long").alias("zeros"),
        F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.when(nonzero, F.col("rank") * (F.col("t") - F.col("up"))).otherwise(0.0)).alias("w_minus"),
        F.sum(t * t * t - t).cast("double").alias("ties"), F.sum("far").alias("far"),
    )


def signed_ranks(table: DataFrame) -> DataFrame:
    """Per type and series, the statistics of the paired signed-rank test: n, zeros, w_plus, w_minus, ties, far."""
    return _statistics(_ranked(table))


def signed_rank_table(table: DataFrame, method: str = "auto", exact_up_to: int = 300) -> DataFrame:
    """type, category, p of the paired signed-rank test, two-sided; zeros are left out of the ranks.

    auto: exact up to 50 differences without zeros or ties, else by the normal distribution. exact: over all signs of the
    ranks, ties included, and null beyond exact_up_to differences, which bounds the shares that a row holds. p is null
    without differences, or if all of them are rounding.
    """
    if method not in ("auto", "exact"):
        raise ValueError(f"unknown method {method!r}")
    keys, ranked = ["type", "category"], _ranked(table)
    w = F.least("w_plus", "w_minus")
    stat = _statistics(ranked).filter("n > 0 and far > 0").select(*keys, "n", "zeros", "ties", w.alias("w"))
    plain = (F.col("n") <= 50) & (F.col("zeros") == 0) & (F.col("ties") == 0)
    stat = stat.withColumn("exact", plain if method == "auto" else F.col("n") <= exact_up_to)
    of = ranked.filter("size > 0").join(stat.filter("exact").select(*keys, (2 * F.col("w")).cast("int").alias("w2")), keys)
    # as many ranks as differences, which are bounded where the test is exact
    rows = F.transform(F.array_sort(F.collect_list(F.struct((2 * F.col("rank")).cast("int").alias("r"), F.col("t").cast("int").alias("t")))), lambda v: F.array_repeat(v["r"], v["t"]))
    listed = of.groupBy(*keys, "w2").agg(F.flatten(rows).alias("ranks"))
    exact = listed.select(*keys, signs_p(F.col("ranks"), F.col("w2")).alias("exact_p"))
    normal = F.when(~F.col("exact"), two_sided(signed_rank_z(F.col("n"), F.col("w"), F.col("ties")))) if method == "auto" else F.lit(None).cast("double")
    p = stat.join(exact, keys, "left").select(*keys, F.coalesce("exact_p", normal).alias("p"))
    return ranked.select(*keys).distinct().join(p, keys, "left")


def significance(p_table: DataFrame, level: float = 0.05) -> DataFrame:
    """type, category, p, significant: an undefined p is not significant."""
    return p_table.withColumn("significant", F.coalesce(F.col("p") < level, F.lit(False)))


def term_split(table: DataFrame, cut: int = 4) -> DataFrame:
    """One row: medians and numbers of short (band below cut) and long cohorts of all contributors, rank sum and z."""
    v = table.filter("category = 'all' and abre_cohort is not null").select(F.col("abre_cohort").alias("x"), (F.col("band") < cut).alias("short"))
    v = written(v, "terms")
    values = v.groupBy("x").agg(F.count("*").alias("t"), F.count_if("short").alias("s"))
    r1 = sum_before(values, [], "x", "t").agg(F.sum((F.col("below") + (F.col("t") + 1) / 2) * F.col("s")).alias("r1"))
    middle = medians(v, ["short"], "x").agg(F.max(F.when(F.col("short"), F.col("median"))).alias("short_median"), F.max(F.when(~F.col("short"), F.col("median"))).alias("long_median"))
    sizes = v.agg(F.count_if("short").alias("short_n"), F.count_if(~F.col("short")).alias("long_n"))
    n1, n2 = F.col("short_n").cast("double"), F.col("long_n").cast("double")
    z = F.when((n1 > 0) & (n2 > 0), (F.col("r1") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
    return middle.crossJoin(sizes).crossJoin(r1).withColumn("z", z)  # rows of one each


def term_split_p(table: DataFrame, cut: int = 4) -> DataFrame:
    """term_split with p, two-sided, without corrections for ties or continuity."""
    return term_split(table, cut).withColumn("p", two_sided(F.col("z")))
