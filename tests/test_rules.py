"""Exact rules at boundaries: dates, settings, spans, bands, ratios, errors, rank tests, checks."""

from datetime import date, datetime, timedelta
from math import erfc, isnan, sqrt
from pathlib import Path
from random import Random

import duckdb
import pytest
from pyspark.sql import functions as F

from agestrata.config import DEFAULT, Settings
from agestrata.functions import stats
from agestrata.functions.lineage import shared_dir
from agestrata.functions.running import medians, sum_before
from agestrata.functions.temporal import anchors, anchors_of, quarter_ends, snapshot_dates
from agestrata.operators import attract, balance, checks, identity, projection, spans, state
from agestrata.queries import tail_sql
from agestrata.sources import base

EVENTS = "scope_id long, contributor_id long, event_type string, timestamp timestamp"
T2 = datetime(2013, 1, 1)


def test_quarter_ends_are_month_ends():
    got = quarter_ends(date(2010, 3, 31), date(2011, 3, 31))
    assert got == [date(2010, 3, 31), date(2010, 6, 30), date(2010, 9, 30), date(2010, 12, 31), date(2011, 3, 31)]
    assert anchors(got) == tuple(got[-3:])
    with pytest.raises(ValueError):
        anchors(got[:2])


def test_snapshot_dates_in_a_plan_are_the_same(spark):
    got = [r.snapshot.date() for r in snapshot_dates(spark, DEFAULT.start, DEFAULT.end).collect()]
    assert sorted(got) == quarter_ends(DEFAULT.start, DEFAULT.end)


@pytest.mark.parametrize("bad", [{"freq_months": 2}, {"band_days": 120}, {"start": date(2002, 1, 1)}, {"taxonomy": "x"}, {"age_basis": "x"}, {"pyramid_population": "x"}])
def test_settings_refuse(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


@pytest.mark.parametrize(("extra", "many"), [(0, 1), (1, 2)])
def test_gap_of_exactly_the_limit_keeps_the_span(spark, extra, many):
    a = datetime(2012, 1, 1)
    b = a + timedelta(microseconds=DEFAULT.gap_us + extra)
    df = spark.createDataFrame([(1, 1, "commits", a), (1, 1, "commits", b)], EVENTS)
    assert spans.activity_spans(df).count() == many


# The worked example of six contributors; months before T2 of coding and of other events.
SIX = {1: (4, 0), 2: (0, 2), 3: (2, 6), 4: (8, 5), 5: (0, 7), 6: (6, 8)}
AT_T1 = {1: ("coding", 0), 3: ("non_coding", 0), 4: ("coding", 1), 5: ("non_coding", 1), 6: ("moved", 0)}
AT_T2 = {1: ("coding", 1), 2: ("non_coding", 0), 3: ("moved", 0), 4: ("coding", 2), 5: ("non_coding", 2), 6: ("moved", 1)}


def six_spans(spark):
    rows = [(1, c, kind, T2 - timedelta(days=30 * k)) for c, months in SIX.items() for kind, n in zip(("commits", "issue_comments"), months, strict=True) if n for k in range(n + 1)]
    return spans.activity_spans(spark.createDataFrame(rows, EVENTS))


def test_six_contributors(spark):
    t1 = T2 - timedelta(days=90)
    rows = state.state_at(six_spans(spark), [t1.date(), T2.date()]).collect()
    assert {r.contributor_id: (r.category, r.band) for r in rows if r.snapshot == t1} == AT_T1
    assert {r.contributor_id: (r.category, r.band) for r in rows if r.snapshot == T2} == AT_T2


@pytest.mark.parametrize(("days", "band"), [(0, 0), (1, 0), (90, 0), (91, 1), (180, 1), (270, 2), (271, 3)])
def test_bands_are_closed_at_the_top(spark, days, band):
    df = spark.createDataFrame([(1, 1, "commits", T2 - timedelta(days=days))], EVENTS)
    assert state.state_at(spans.activity_spans(df), [T2.date()]).first().band == band


def test_unknown_snapshot_is_an_error(spark):
    at = state.state_at(six_spans(spark), [T2.date()])
    assert state.at_date(at, T2.date()).count() == 6
    with pytest.raises(ValueError, match="2013-01-01"):
        state.at_date(at, date(2001, 1, 1))


def test_ratios_and_types(spark):
    df = spark.createDataFrame([(4, 2), (2, 4), (3, 3), (0, 0)], "a long, b long")
    assert [r[0] for r in df.select(balance.ratio(F.col("a"), F.col("b"))).collect()] == [0.5, -0.5, 0.0, None]
    df = spark.createDataFrame([(1.0, 1.0), (-1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0)], "c double, n double")
    assert [r[0] for r in df.select(balance.balance_type(F.col("c"), F.col("n"))).collect()] == ["A", "B", "C", "D", None]


# The worked example of magnet and sticky projects.
DEV_YEARS = [(1, 1, 2010), (1, 1, 2011), (1, 1, 2012), (1, 2, 2011), (1, 2, 2012), (1, 3, 2011), (2, 4, 2011), (2, 4, 2012), (2, 5, 2012)]


def test_magnet_and_sticky(spark):
    df = spark.createDataFrame([*DEV_YEARS, (2, 5, 2013)], "scope_id long, contributor_id long, year int")
    at = {(r.scope_id, r.year): r for r in attract.annual(df).collect()}
    assert at[1, 2011].newcomers_total == 3
    assert at[1, 2011].magnetism == pytest.approx(2 / 3) and at[2, 2011].magnetism == pytest.approx(1 / 3)
    assert at[1, 2011].stickiness == pytest.approx(2 / 3) and at[2, 2011].stickiness == 1


def test_newcomers_are_new_anywhere(spark):
    df = spark.createDataFrame([(1, 9, 2010), (1, 9, 2011), (2, 9, 2011), (1, 8, 2011)], "scope_id long, contributor_id long, year int")
    at = {(r.scope_id, r.year): r for r in attract.annual(df).collect()}
    assert at[1, 2011].newcomers_total == 1 and at[1, 2011].magnetism == 1 and at[2, 2011].magnetism == 0
    assert at[1, 2011].right_censored and at[1, 2011].stickiness is None


# Base, last, expected prediction by band; None is an orphan.
VECTORS = [
    ([10, 8, 4], [20, 5, 4], [15, 10, 2.5]), ([10, 0], [20, 0], [15, 0]), ([0, 4], [7, 4], [3.5, None]), ([0, 0], [0, 0], [0, 0]),
    ([10, 9, 8, 7], [12, 10, 9, 8], [11, 12, 10, 9]),
]


@pytest.mark.parametrize(("first", "last", "want"), VECTORS)
def test_cohort_projection(spark, first, last, want):
    df = spark.createDataFrame([(1, "all", b, float(x), float(y), 0.0) for b, (x, y) in enumerate(zip(first, last, strict=True))], "scope_id long, category string, band int, base double, last double, actual double")
    got = [r.cohort_pred for r in projection.cohort_projection(df).orderBy("band").collect()]
    assert got == [None if w is None else pytest.approx(w) for w in want]


def test_balanced_errors(spark):
    pairs = [(2, 3, 0.5), (3, 2, 0.5), (5, 5, 0), (0, 4, None), (4, 0, None), (3, 4, 1 / 3), (3, 5, 2 / 3), (4, 7, 0.75), (2, 4, 1), (None, 4, None)]
    df = spark.createDataFrame([(None if a is None else float(a), float(b)) for a, b, _ in pairs], "a double, b double")
    got = [r[0] for r in df.select(projection.abre(F.col("a"), F.col("b"))).collect()]
    assert got == [None if w is None else pytest.approx(w) for _, _, w in pairs]


def test_normal_tails(spark):
    zs = [0.0, 1e-9, 0.5, 1.0, 1.959963984540054, 2.5, 2.8284271, 2.8284272, 3.0, 5.0, 9.0, 30.0, -2.0]
    got = spark.createDataFrame([(i, z) for i, z in enumerate([*zs, None])], "i int, z double").select("i", stats.two_sided(F.col("z")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got[:-1]] == pytest.approx([erfc(abs(z) / sqrt(2)) for z in zs], rel=1e-10) and got[-1].p is None


def test_normal_tails_of_sql():
    zs = [0.0, 0.5, 1.959963984540054, -2.5, 5.0]
    got = duckdb.sql(f"select {tail_sql('z')} from (values {', '.join(f'({z}::double)' for z in zs)}) v(z)").fetchall()
    assert [p for (p,) in got] == pytest.approx([erfc(abs(z) / sqrt(2)) for z in zs], abs=1e-11)


def test_exact_signed_rank_counts_all_signs(spark):
    draw = Random(5)
    sets = {f"{k}": [draw.choice([-3, -2, -1, 0, 1, 2, 3, 4, 5]) for _ in range(k % 11 + 1)] for k in range(60)} | {"five": [1, 2, 3, 4, 5], "none": [0, 0, 0]}
    rows = [(i, t, "all", float(max(0, v)), float(max(0, -v))) for t, vs in sets.items() for i, v in enumerate(vs)]
    table = spark.createDataFrame(rows, "scope_id int, type string, category string, abre_cohort double, abre_baseline double")
    got = {r.type: r.p for r in projection.signed_rank_table(table, "exact").collect()}
    assert set(got) == set(sets) | {"All types"}
    for t, vs in sets.items():
        size = sorted(abs(v) for v in vs if v)
        rank = {x: size.index(x) + (size.count(x) + 1) / 2 for x in size}
        up, all_ = sum(rank[v] for v in vs if v > 0), len(size) * (len(size) + 1) / 2
        sums = [sum(rank[x] for k, x in enumerate(size) if s >> k & 1) for s in range(1 << len(size))]
        want = min(1, 2 * sum(x <= min(up, all_ - up) for x in sums) / len(sums)) if size else None
        assert got[t] == (None if want is None else pytest.approx(want, abs=1e-12)), (t, vs)
    assert got["five"] == 2 / 32 and got["All types"] is None  # more differences than exact_up_to
    auto = {r.type: r.p for r in projection.signed_rank_table(table).collect()}
    assert auto["five"] == 2 / 32 and auto["none"] is None and 0 < auto["All types"] < 1
    with pytest.raises(ValueError, match="neither"):
        projection.signed_rank_table(table, "neither")


# Gate, match, declared, unavailable, status.
STATUS = [
    (True, True, "", False, "ok"), (True, True, "d", False, "OBSOLETE"), (True, False, "", False, "FAIL"), (True, False, "d", False, "known"),
    (False, True, "", False, "ok"), (False, True, "d", False, "ok"), (False, False, "", False, "~"), (False, False, "d", False, "known"), (True, True, "d", True, "n/a"),
]
CHECK = "key string, expected string, obtained string, match boolean, gate boolean, unavailable boolean"


def test_status_of_checks(spark):
    some = spark.createDataFrame([(f"k{i}", "1", "1", m, g, u) for i, (g, m, _, u, _) in enumerate(STATUS)], CHECK)
    declared = spark.createDataFrame([(f"k{i}", d) for i, (_, _, d, _, _) in enumerate(STATUS) if d], checks.DECLARED)
    assert {r.key: r.status for r in checks.verify(some, declared).collect()} == {f"k{i}": x[-1] for i, x in enumerate(STATUS)}


def test_declarations_must_cover_something(spark):
    rows = [("a.x", "1", "2", False, True, False), ("a.b.y", "1", "2", False, True, False), ("b", "1", "1", True, True, False), ("c.z", "1", "1", True, True, False)]
    some = spark.createDataFrame(rows, CHECK)
    told = lambda **d: {r.key: (r.status, r.ref) for r in checks.verify(some, spark.createDataFrame([(k.replace("_", "."), v) for k, v in d.items()] or [], checks.DECLARED)).collect()}
    assert told()["a.x"] == ("FAIL", None)
    got = checks.verify(some, spark.createDataFrame([("a.*", "wide"), ("a.b.*", "narrow"), ("gone", "g"), ("c.*", "all match")], checks.DECLARED))
    assert {r.key: (r.status, r.ref) for r in got.collect()} == {
        "a.x": ("known", "wide"), "a.b.y": ("known", "narrow"), "b": ("ok", None), "c.z": ("ok", "all match"), "gone": ("FAIL", "g"), "c.*": ("OBSOLETE", "all match"),
    }
    assert {r.key for r in checks.fatal(got).collect()} == {"gone", "c.*"}


def test_expected_facts(spark):
    expected = [("t.1", "A", None, True, None), ("n.1", None, 0.4055, True, 0.02), ("n.2", None, 0.45, True, 0.02), ("n.0", None, 0.0, False, 0.02), ("none", "A", None, True, None)]
    facts = [("t.1", "A", None), ("n.1", None, 0.4), ("n.2", None, 0.4), ("n.0", None, 0.01)]
    got = checks.compare(spark.createDataFrame(expected, checks.EXPECTED), spark.createDataFrame(facts, "key string, text string, number double"))
    assert {r.key: (r.match, r.unavailable) for r in got.collect()} == {"t.1": (True, False), "n.1": (True, False), "n.2": (False, False), "n.0": (True, False), "none": (False, True)}


def test_dirty_rows_are_dropped(spark):
    raw = [(1, 1.0, "commits", "2012-03-01 10:00:00"), (1, 2.0, "commits", "2012-04-02 11:30:00"), (1, None, "issues", "2012-05-03 09:00:00"), (1, 2.0, "issues", "0000-00-00 00:00:00"), (1, 1.0, "commits", "2013-01-04 08:15:00")]
    got = base.clean(spark.createDataFrame(raw, "scope_id long, contributor_id double, event_type string, timestamp string"))
    assert got.count() == 3 and sum(r.rows for r in base.violations(got).collect()) == 0
    with pytest.raises(TypeError):
        base.violations(got.drop("timestamp"))


def test_identities_close_over_chains(spark):
    rows = [(1, "a@x", "Ann Lee"), (2, "A@x ", "Bo Ray"), (3, None, "bo  ray"), (4, "no mark", "root"), (5, None, "root"), (6, "@x", "Solo")]
    users = spark.createDataFrame(rows, "id long, email string, name string")
    assert {tuple(r) for r in identity.alias_map(users, "email").collect()} == {(2, 1)}
    assert {tuple(r) for r in identity.alias_map(users, "email_name").collect()} == {(2, 1), (3, 1)}
    with pytest.raises(ValueError):
        identity.alias_map(users, "x")


def test_unknown_source_is_an_error():
    with pytest.raises(ValueError, match="star"):
        base.load("none")


def test_white_space_of_any_kind_is_trimmed(spark):
    users = spark.createDataFrame([(1, "\ta@x\n", "x"), (2, "A@X\u00a0", "y")], "id long, email string, name string")
    assert {tuple(r) for r in identity.alias_map(users, "email").collect()} == {(2, 1)}


def test_people_merge_only_through_their_scope(spark):
    users = spark.createDataFrame([(1, "a@x", "Ann Lee"), (2, "a@x", "Bo Ray"), (3, "b@x", "Bo Ray")], "id long, email string, name string")
    people = spark.createDataFrame([(7, 1), (7, 3), (8, 1), (8, 2), (8, 3), (9, 2), (9, 3)], "scope_id long, contributor_id long")
    got = {tuple(r) for r in identity.alias_map_by_scope(people, users, "email_name").collect()}
    assert got == {(8, 2, 1), (8, 3, 1), (9, 3, 2)}
    events = spark.createDataFrame([(7, 3, "commits", T2), (8, 3, "commits", T2)], EVENTS)
    merged = identity.merge_identities(events, identity.alias_map_by_scope(people, users, "email_name"))
    assert {(r.scope_id, r.contributor_id) for r in merged.collect()} == {(7, 3), (8, 1)}


def test_negative_counts_are_errors(spark):
    df = spark.createDataFrame([(-1.0, 2.0)], "a double, b double")
    with pytest.raises(Exception, match="negative"):
        df.select(projection.abre(F.col("a"), F.col("b"))).collect()


def test_scopes_are_checked(spark):
    ddl = "scope_id long, label string, language string, created_at timestamp"
    base.check_scopes(spark.createDataFrame([(1, "a/b", None, T2)], ddl), 1)
    for bad in ([(1, " ", None, T2)], [(1, "a", None, T2), (1, "b", None, T2)], [(None, "a", None, T2)], []):
        with pytest.raises(ValueError):
            base.check_scopes(spark.createDataFrame(bad, ddl), 1)
    with pytest.raises(TypeError, match="created_at timestamp"):
        base.check_scopes(spark.createDataFrame([(1, "a", "b", "c")], "scope_id long, label string, language string, created_at string"))


def test_sums_before_go_over_ranges(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "cast(id * 7919 % 1009 as double) as x", "id % 5 as v")
    got = sum_before(df, ["k"], "x", "v").collect()
    rows = sorted((r.k, r.x, r.v) for r in got)
    want, at = {}, {}
    for k, x, v in rows:
        want[k, x] = at.get(k, 0)
        at[k] = at.get(k, 0) + v
    assert len(got) == 500 and {(r.k, r.x): r.below for r in got} == want


def test_medians_go_over_ranges(spark):
    inf, nan = float("inf"), float("nan")
    odd = [("odd", x) for x in (1.0, None, 2.0, 2.0)] + [("inf", x) for x in (inf, inf, 1.0, inf)] + [("far", x) for x in (-inf, inf)] + [("nan", x) for x in (1.0, nan, 2.0)] + [("none", None)] + [("two", 1.0), ("two", 2.0)]
    hot = [("hot", float(i * 7919 % 1009)) for i in range(3000)] + [("ties", 4.0)] * 500
    df = spark.createDataFrame(odd + hot, "k string, x double")
    got = {r.k: r.median for r in medians(df, ["k"], "x").collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("x").alias("m")).collect()}
    assert isnan(got.pop("far")) and isnan(want.pop("far")) and want.pop("none") is None and got == want
    before = set(Path(shared_dir(spark).removeprefix("file://")).glob("agestrata-ranges-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a group would be put together again
    try:
        assert medians(df.filter("k = 'hot'"), ["k"], "x").count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (ranges,) = set(Path(shared_dir(spark).removeprefix("file://")).glob("agestrata-ranges-*")) - before
    rows = [spark.read.parquet(str(f)).count() for f in ranges.glob("*.parquet")]
    assert len(rows) > 1 and sum(rows) == 1009 and max(rows) < 600  # one group over several tasks
    assert medians(df.filter("k = 'two'"), [], "x").collect()[0].median == 1.5 and medians(df.limit(0), ["k"], "x").count() == 0


def test_anchors_must_be_dates_of_the_series():
    dates = quarter_ends(DEFAULT.start, DEFAULT.end)
    three = tuple(dates[3:6])
    assert anchors_of(DEFAULT, dates) == tuple(dates[-3:]) and anchors_of(DEFAULT.but(anchors=three), dates) == three
    with pytest.raises(ValueError, match="1901-01-01"):
        anchors_of(DEFAULT.but(anchors=(date(1901, 1, 1), *three[1:])), dates)


def test_state_and_spans_hold_no_table_of_groups(spark, sf_dir):
    """Spans and state pass in one order of time, so a task holds a sort that can spill; only days are aggregated, twice."""
    from agestrata import queries

    plan = queries._state(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate(") == 2  # by day, before and after the shuffle
    assert plan.count("Sort [scope_id") == 1


def test_pyramid_reads_state_once(spark, sf_dir):
    from agestrata import queries

    plan = balance.pyramid(queries._state(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem") == 1


def test_spans_are_shared_out_by_the_size_of_the_input(spark, sf_dir, monkeypatch):
    """However large the input, a task has as much: all that spans need goes to as many tasks as the files' size says."""
    from agestrata import queries
    from agestrata.sources import star

    want = {tuple(r) for r in queries._spans(spark, sf_dir).collect()}
    monkeypatch.setattr(star, "TASK", 1 << 10)
    many = star.StarSource(spark=spark, path=sf_dir).tasks()
    got = queries._spans(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert many > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan.count("Exchange hashpartitioning") == plan.count(f", {many}), REPARTITION_BY_NUM") == 4  # both sides of the join, by day, by contributor
    assert {tuple(r) for r in got.collect()} == want
