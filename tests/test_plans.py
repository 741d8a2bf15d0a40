"""Stage tables, resumption, runs of their own, commands, and reading what a person typed."""

import json
import logging
from datetime import UTC, date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agestrata import __main__ as commands
from agestrata.config import DEFAULT
from agestrata.operators import attract, balance, figures
from agestrata.plans import names, stages
from agestrata.plans.store import JsonLines, Store, ordered
from agestrata.sources.star import StarSource

SHORT = DEFAULT.but(start=date(1997, 3, 31), end=date(1998, 3, 31), min_contributors=5)


@pytest.fixture(scope="module")
def filled(spark, sf_dir, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    assert stages.run(store, StarSource(SHORT, spark=spark, path=sf_dir), SHORT) == list(stages.STAGES)
    return store


def test_stages_run_again_only_where_something_changed(spark, sf_dir, filled):
    source = StarSource(SHORT, spark=spark, path=sf_dir)
    assert stages.run(filled, source, SHORT) == []
    assert stages.run(filled, source, SHORT, force=True, only="metrics") == ["metrics"]
    filled._files("annual")[1].delete(filled._files("annual")[0], True)
    assert stages.run(filled, source, SHORT) == ["attractiveness"]
    with pytest.raises(ValueError, match="no stage"):
        stages.run(filled, source, SHORT, first="x")
    known = {r.stage: r for r in filled.manifest().collect()}
    assert set(known) == {t for tables, _ in stages.STAGES.values() for t in tables} and known["events"].rows == filled.read("events").count()
    assert sum(r.rows for r in stages.broken(filled).collect()) == 0


def test_another_window_is_another_state(spark, sf_dir, filled, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    moved = commands.settings_of("1997-06-30", "1998-03-31", SHORT)
    two = sorted(r.scope_id for r in filled.read("events").select("scope_id").distinct().collect())[:2]
    stages.run(store, StarSource(moved, spark=spark, path=sf_dir), moved, scopes=two)
    assert {r.scope_id for r in store.read("scopes").collect()} == set(two)
    assert {r.snapshot.date() for r in store.read("state").select("snapshot").distinct().collect()} == {date(1997, 6, 30), date(1997, 9, 30), date(1997, 12, 31), date(1998, 3, 31)}


def test_a_cut_by_date_reads_its_folder_only(filled):
    from agestrata.functions.temporal import midnight

    cut = filled.read("state").filter(F.col("snapshot") == midnight(date(1997, 9, 30)))
    spark = filled.spark
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert "PartitionFilters: [isnotnull(snapshot" in plan and cut.count()


def test_dates_and_years_that_are_not_there_are_errors(filled):
    metrics, scopes, gone = filled.read("metrics"), filled.read("scopes"), date(2001, 3, 31)
    for asked in (lambda: balance.type_table(metrics, scopes, gone), lambda: balance.type_counts(metrics, scopes, gone), lambda: figures.type_scatter(metrics, scopes, gone), lambda: figures.pyramids_of(filled.read("state"), [1], [gone])):
        with pytest.raises(ValueError, match="no snapshot 2001-03-31; there are 1997-03-31"):
            asked()
    for asked in (lambda: figures.magnet_sticky(filled.read("annual"), scopes, 1901), lambda: attract.year_table(filled.read("annual"), scopes, 1901)):
        with pytest.raises(ValueError, match="no year 1901"):
            asked()


def test_shown_in_order_nulls_last(spark):
    df = spark.createDataFrame([(None, "b"), ("B", "z"), ("A", "y"), ("B", "a")], "type string, label string")
    assert [tuple(r) for r in ordered(df, "types").collect()] == [("A", "y"), ("B", "a"), ("B", "z"), (None, "b")]


def test_grid_rows_split_again(filled):
    grid = attract.quadrant_grid(filled.read("annual"))
    assert {tuple(r) for r in attract.grid_cells(attract.grid_rows(grid)).collect()} == {tuple(r) for r in grid.collect()}


def test_runs_have_folders_of_their_own(filled):
    own = filled.run("first", datetime(2020, 1, 2, tzinfo=UTC))
    assert own.root.endswith("runs/20200102T000000-first") and own.has("_run.json") and filled.has("runs/latest")
    points = figures.data(filled.read, "type-scatter", [], date(1998, 3, 31), 1998)["type-scatter"]
    back = filled.spark.read.option("header", True).csv(own.csv("scatter", points))
    assert back.count() == points.count() and back.columns == points.columns
    with pytest.raises(ValueError, match="exists"):
        filled.run("first", datetime(2020, 1, 2, tzinfo=UTC))


def test_labels_come_from_the_store_or_the_source(spark, sf_dir, filled, tmp_path):
    source = StarSource(SHORT, spark=spark, path=sf_dir)
    assert stages.labels(filled).count() == stages.labels(Store(spark, f"file://{tmp_path}/none"), source).count() == 25
    with pytest.raises(ValueError, match="no table"):
        stages.labels(Store(spark, f"file://{tmp_path}/none"))


def test_summary_has_the_last_metrics(filled):
    rows = stages.summary(filled).collect()
    assert len(rows) == filled.read("events").select("scope_id").distinct().count() and max(r.snapshot for r in rows if r.snapshot).date() == date(1998, 3, 31)


def test_names_dates_and_years(filled):
    scopes = filled.read("scopes")
    two = filled.spark.createDataFrame([(1, "a/x"), (2, "b/X")], "scope_id long, label string")
    label = scopes.filter("scope_id = 3").first().label
    assert names.scope_of("3", scopes) == names.scope_of(label.lower(), scopes) == names.scope_of(label[3:].upper(), scopes) == 3
    for bad, why in (("99", "no scope 99"), ("atlantis", "ends with"), ("/x", "give the id")):
        with pytest.raises(ValueError, match=why):
            names.scope_of(bad, scopes if bad != "/x" else two)
    assert names.year_of("2011") == names.year_of(2011) == names.year_of("2011-12-31") == 2011
    with pytest.raises(ValueError):
        names.day_of("31.12.2011")


def test_log_lines_are_json():
    r = logging.LogRecord("agestrata", logging.INFO, "", 0, "written %s", ("x",), None)
    r.stage = "metrics"
    assert json.loads(JsonLines().format(r)).items() >= {"level": "INFO", "message": "written x", "stage": "metrics"}.items()


def test_long_tables_say_what_they_leave_out(spark):
    df = spark.range(12).orderBy("id")
    assert figures.markdown(df, 12).count("\n") == 13 and figures.markdown(df, 10).endswith("| 9 |\n\n2 more rows are left out.")


def test_commands(spark, sf_dir, tmp_path, capsys):
    base = ["--store", f"file://{tmp_path}/s", "--path", sf_dir, "--start", "1997-03-31", "--end", "1998-03-31"]
    assert commands.main([*base, "run-all"], spark) == 0 and commands.main([*base, "run-all"], spark) == 0
    assert "ran: extract, classify" in (said := capsys.readouterr().out) and "nothing" in said
    assert commands.main([*base, "types"], spark) == 0 and commands.main([*base, "magnetism", "--year", "1997-12-31"], spark) == 0
    assert "| scope_id | label |" in capsys.readouterr().out
    some = Store(spark, base[1]).read("events").first().scope_id
    assert commands.main([*base, "plot", "--figure", "pyramid-single", "--scope", str(some)], spark) == 0
    assert "pyramid-single" in capsys.readouterr().out
    assert commands.main([*base, "plot", "--list"], spark) == 0 and "magnet-sticky" in (said := capsys.readouterr().out) and "pyramid-single (of chosen scopes)" in said
    assert commands.main([*base, "plot", "--figure", "type-scatter", "--highlight", str(some), "--label", "lit"], spark) == 0
    points = spark.read.option("header", True).csv(capsys.readouterr().out.split(" ", 1)[1].strip())
    assert {r.scope_id for r in points.filter("highlighted = 'true'").collect()} == {str(some)}
    with pytest.raises(ValueError, match="no points of scopes"):
        commands.main([*base, "plot", "--figure", "abre-table", "--highlight", str(some)], spark)
    assert commands.main([*base, "run-all", "--run", "--label", "mine"], spark) == 0 and "-mine/summary" in capsys.readouterr().out
    assert commands.main([*base, "extract", "--scope", str(some), "--force", "--fail-fast"], spark) == 0 and "ran: extract" in capsys.readouterr().out
    there = Store(spark, base[1]).read("metrics").filter("snapshot = timestamp '1998-03-31'").first().scope_id
    (tmp_path / "expected.json").write_text(f'{{"key": "types.{there}", "text": "Z"}}\n{{"key": "types.count.Q", "number": 1.0, "gate": false}}\n')
    (tmp_path / "declared.json").write_text(f'{{"key": "types.{there}", "ref": "told"}}\n')
    check = [*base, "validate", "--expected", f"file://{tmp_path}/expected.json", "--declared", f"file://{tmp_path}/declared.json"]
    assert commands.main(check, spark) == 1  # nothing has the second key
    assert commands.main([*check, "--verbose", "--run", "--label", "v"], spark) == 1 and "types.count.Q" in (said := capsys.readouterr().out) and "-v/validation.md" in said
    assert "n/a" in (tmp_path / "s/validation.md").read_text() and "known" in (tmp_path / "s/validation.md").read_text()


# ---- runs by scope ----


class Some(StarSource):
    """A source whose events can be spoilt or grow, as a real one does between runs."""

    more = None

    def events(self):
        own = super().events()
        return own if self.more is None else own.unionByName(self.more)


def content(store, name):
    return sorted(map(tuple, store.read(name).collect()), key=repr)


@pytest.fixture(scope="module")
def spans_of(spark, sf_dir, tmp_path_factory):
    """Makes a store with the stages that go by scope."""

    def make(source, **how):
        store = Store(spark, f"file://{tmp_path_factory.mktemp('units')}/s", **how)
        for stage in ("extract", "classify"):
            stages.run(store, source, SHORT, only=stage)
        return store

    return make


def test_a_scoped_run_leaves_the_rows_of_others(spark, sf_dir, spans_of):
    source = Some(SHORT, spark=spark, path=sf_dir)
    store = spans_of(source)
    before = {n: content(store, n) for n in ("events", "scopes", "spans")}
    assert stages.run(store, source, SHORT, only="extract", scopes=[3], force=True) == ["extract"]
    assert {n: content(store, n) for n in before} == before
    # nothing to do where content is the same; one more event of scope 3 makes that scope's spans again, and no other's
    assert stages.run(store, source, SHORT, only="classify") == []
    versions = {r.scope_id: r.version for r in store.scope_entries("spans").collect()}
    Some.more = spark.createDataFrame([(3, 999, "commits", datetime(1998, 1, 1))], before_schema := store.read("events").schema)
    try:
        assert stages.run(store, source, SHORT, only="extract", scopes=[3], force=True) == ["extract"]
        assert stages.run(store, source, SHORT, only="classify") == ["classify"]
    finally:
        Some.more = None
    after = {r.scope_id: r.version for r in store.scope_entries("spans").collect()}
    assert [s for s in after if after[s] != versions[s]] == [3] and before_schema == store.read("events").schema
    assert set(content(store, "spans")) - set(before["spans"]) == {(3, 999, datetime(1998, 1, 1), datetime(1998, 1, 1), 0, datetime(1998, 1, 1), None)}
    assert stages.run(store, source, SHORT, only="extract", force=True) == ["extract"] and content(store, "events") == before["events"]


def test_stages_of_the_whole_dataset_refuse_scopes(spark, sf_dir, filled):
    source = StarSource(SHORT, spark=spark, path=sf_dir)
    for stage in stages.GLOBAL:
        with pytest.raises(ValueError, match="whole dataset"):
            stages.run(filled, source, SHORT, only=stage, scopes=[3])


def test_a_failing_scope_is_listed_and_the_others_written(spark, sf_dir, spans_of, tmp_path):
    source = Some(SHORT, spark=spark, path=sf_dir)
    good = spans_of(source)
    Some.more = spark.createDataFrame([(3, 5, "dances", datetime(1998, 1, 1)), (3, 5, "commits", datetime(2999, 1, 1)), (4, 5, "commits", datetime(2999, 1, 1))], good.read("events").schema)
    store = Store(spark, f"file://{tmp_path}/s")
    try:
        with pytest.raises(stages.Failed, match="scope 3, unknown_type: 1, future_timestamp: 1; scope 4, future_timestamp: 1"):
            stages.run(store, source, SHORT, only="extract", fail_fast=True)
        assert not store.has("events")
        with pytest.raises(stages.Failed, match="2 scopes failed"):
            stages.run(store, source, SHORT)
    finally:
        Some.more = None
    assert {r.scope_id for r in stages.failures(store).collect()} == {3, 4} and not store.has("spans")
    assert content(store, "events") == [r for r in content(good, "events") if r[0] not in (3, 4)]
    # mended, only those two are made again
    assert stages.run(store, source, SHORT, only="extract") == ["extract"] and stages.failures(store).isEmpty()
    versions = {r.scope_id: r.version for r in store.scope_entries("events").collect()}
    assert content(store, "events") == content(good, "events") and versions[3] == versions[4] and sum(v == versions[3] for v in versions.values()) == 2


def test_a_broken_table_is_made_again(spark, sf_dir, spans_of):
    source = Some(SHORT, spark=spark, path=sf_dir)
    store = spans_of(source)
    want = content(store, "spans")
    path, files = store._files("spans")
    part = next(f for f in store.spark.read.parquet(store.path("spans")).inputFiles())
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(part), False)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"), False)
    with pytest.raises(ValueError, match="isn't whole"):
        store.read("spans")
    assert stages.run(store, source, SHORT, only="classify") == ["classify"] and content(store, "spans") == want
    # killed between the renaming and the note: the manifest says begun
    store._note("spans", status="begun", version="x")
    assert stages.run(store, source, SHORT, only="classify", scopes=[3]) == ["classify"] and content(store, "spans") == want
    # killed before the renaming: what lies aside is nothing to a reader
    store._aside("spans", store.read("spans").limit(1), __import__("pyspark.sql").sql.Observation(), {})
    assert content(store, "spans") == want


def test_contributors_stay_in_their_buckets(spark, sf_dir, spans_of):
    """From stored spans to state nothing is exchanged, events are days before they are exchanged, and a bucketed table
    has a file for each bucket and folder."""
    from agestrata.operators import spans, state

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    store = spans_of(Some(SHORT, spark=spark, path=sf_dir), units=2, buckets=5)
    own = store.read("spans")
    at = state.state_at(own, None, SHORT)
    for df in (at, at.repartition(5, "scope_id", "contributor_id")):
        assert "Bucketed: true" in plan(df) and "Exchange" not in plan(df)
    made = plan(spans.activity_spans(store.read("events"), SHORT))
    assert made.rindex("Exchange") < made.rindex("partial_min(timestamp")
    assert len(own.inputFiles()) <= 2 * 5


def test_stored_content_is_the_same_whatever_the_partitions(spark, sf_dir, spans_of):
    source = Some(SHORT, spark=spark, path=sf_dir)
    stores, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            stores.append(spans_of(source))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    a, b = ({r.stage: (r.rows, r.digest, r.files) for r in s.manifest().collect()} for s in stores)
    assert a == b and len(a) == 3

    def files(store):
        """The rows of each file in the order they lie in, by folder and bucket."""
        at = F.input_file_name()
        rows = store.spark.read.parquet(store.path("events")).select(F.regexp_extract(at, r"unit=\d+", 0).alias("u"), F.regexp_extract(at, r"part-(\d+)-", 1).alias("b"), F.monotonically_increasing_id().alias("i"), "*")
        out = {}
        for r in rows.orderBy("u", "b", "i").collect():
            out.setdefault((r.u, r.b), []).append((r.scope_id, r.contributor_id, r.timestamp, r.event_type))
        return out

    one, two = map(files, stores)
    assert one == two and all(rows == sorted(rows) for rows in one.values())


def test_manifest_figures_are_those_of_the_summary(filled):
    from agestrata.operators import spans

    want = {tuple(r) for r in spans.scope_summary(filled.read("events")).collect()}
    got = filled.scope_entries("events").filter("rows > 0").select("scope_id", "rows", "contributors", "first", "last")
    assert {tuple(r) for r in got.collect()} == want
    row = {r.stage: r for r in filled.manifest().collect()}["events"]
    assert (row.rows, row.scopes, row["first"], row["last"]) == (sum(r[1] for r in want), len(want), min(r[3] for r in want), max(r[4] for r in want))


def test_the_number_of_scopes_is_guarded(spark, sf_dir, tmp_path):
    few = SHORT.but(expected_scopes=24)
    with pytest.raises(ValueError, match="25 scopes, 24 expected"):
        stages.run(Store(spark, f"file://{tmp_path}/s"), StarSource(few, spark=spark, path=sf_dir), few)


# ---- late events ----


@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 400), st.booleans(), st.booleans()), min_size=1, max_size=30))
@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
def test_any_split_of_events_gives_the_spans_of_the_whole(spark, drawn):
    from agestrata.operators import spans

    rows = [(7, who, "commits" if coding else "issue_events", datetime(1998, 1, 1) + timedelta(days=day * 4.56)) for who, day, coding, _ in drawn]
    schema = "scope_id long, contributor_id long, event_type string, timestamp timestamp"
    early, late = (spark.createDataFrame([r for r, d in zip(rows, drawn, strict=True) if d[3] == of], schema) for of in (False, True))
    old = spans.activity_spans(early, SHORT)
    made = spans.with_late(old, late, SHORT)
    people = {r.contributor_id for r in late.collect()}
    want = {tuple(r) for r in spans.activity_spans(early.unionByName(late), SHORT).collect()}
    assert {tuple(r) for r in made.collect()} == {r for r in want if r[1] in people}
    assert {tuple(r) for r in spans.with_late(made, late, SHORT).collect()} == {tuple(r) for r in made.collect()}


def test_late_files_end_in_the_store_of_the_whole(spark, sf_dir, spans_of, tmp_path):
    from agestrata.streaming.spans import follow

    source = Some(SHORT, spark=spark, path=sf_dir)
    whole, events = spans_of(source), source.events()
    some = sorted(r.scope_id for r in events.select("scope_id").distinct().collect())[2:5]
    late = F.col("scope_id").isin(*some) & (F.pmod(F.xxhash64("contributor_id", "timestamp"), F.lit(3)) == 0)
    early = Some(SHORT, spark=spark, path=sf_dir)
    early.events = lambda: events.filter(~late)
    store = spans_of(early)
    stages.run(store, early, SHORT, only="snapshots")
    versions = {r.scope_id: r.version for r in store.scope_entries("spans").collect()}
    events.filter(late).repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second time nothing is new
        follow(store, str(tmp_path / "in"), str(tmp_path / "ck"), SHORT, 2).awaitTermination(300)
    assert stages.add_late(store, events.filter(late), SHORT) == []
    distinct = lambda s, name: set(content(s, name))
    assert distinct(store, "events") == distinct(whole, "events") and content(store, "spans") == content(whole, "spans")
    after = {r.scope_id: r.version for r in store.scope_entries("spans").collect()}
    assert {s for s in after if after[s] != versions[s]} == set(some)
    # state is made again for these scopes alone
    assert stages.run(store, early, SHORT, only="snapshots") == ["snapshots"]
    stages.run(whole, source, SHORT, only="snapshots")
    assert content(store, "state") == content(whole, "state")
    with pytest.raises(ValueError, match="no scope 999"):
        stages.add_late(store, events.limit(1).withColumn("scope_id", F.lit(999).cast("long")), SHORT)


def test_state_of_all_scopes_is_written_as_it_comes(spark, sf_dir, tmp_path, monkeypatch):
    """No task sorts it, its files are in order all the same, and its people are counted without a table of them."""
    from agestrata.operators import state
    from agestrata.plans import store as at

    many, once = [], at._files_at_once
    monkeypatch.setattr(at, "_files_at_once", lambda spark_, n: many.append(n) or once(spark_, n))
    store = Store(spark, f"file://{tmp_path}/s", units=2, buckets=3)
    source = StarSource(SHORT, spark=spark, path=sf_dir)
    for name in ("extract", "classify", "snapshots"):
        stages.run(store, source, SHORT, only=name)
    assert many == [0, at.AT_ONCE + 1, at.AT_ONCE + 1] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    own = store.read("state")
    assert own.exceptAll(state.state_at(store.read("spans"), None, SHORT)).isEmpty() and own.count() == state.state_at(store.read("spans"), None, SHORT).count()
    files = {}
    lie = spark.read.parquet(store.path("state")).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "scope_id", "contributor_id")
    for r in lie.orderBy("i").collect():
        files.setdefault(r.f, []).append((r.scope_id, r.contributor_id))
    assert len(files) <= 2 * 3 * 5 and all(rows == sorted(rows) for rows in files.values())
    for name in ("spans", "state"):
        want = {tuple(r) for r in store.read(name).groupBy("scope_id").agg(F.countDistinct("contributor_id")).collect()}
        assert {tuple(r) for r in store.scope_entries(name).filter("rows > 0").select("scope_id", "contributors").collect()} == want
