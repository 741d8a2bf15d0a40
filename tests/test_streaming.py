"""Spans of a stream against those of the same rows in batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from agestrata.config import DEFAULT
from agestrata.functions.temporal import quarter_ends
from agestrata.operators import attract, state
from agestrata.operators import spans as batch
from agestrata.sources.star import StarSource
from agestrata.streaming import live, spans
from agestrata.streaming import years as retention_of_years


def test_stream_gives_the_sessions_that_are_final(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    ordered = rows.orderBy("ts")
    ordered.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    spans.start(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(300)
    streamed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {tuple(r) for r in spans.session_spans(spans.click_events(rows)).collect()}
    assert streamed and streamed <= whole
    newest = max(r[3] for r in whole)
    assert all((newest - r[3]).days < 2 for r in whole - streamed)


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return StarSource(DEFAULT, spark=spark, path=sf_dir, scope="region").events()


def test_live_state_of_shuffled_files_is_that_of_the_batch(spark, events, tmp_path):
    """Files come in any order, and the query is stopped and started again between them."""
    last = quarter_ends(DEFAULT.start, DEFAULT.end)[-1]
    events = events.filter(F.col("timestamp") <= F.lit(str(last)).cast("timestamp"))
    for part in events.orderBy(F.xxhash64("contributor_id", "timestamp")).randomSplit([1.0, 1.0], 3):
        part.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        live.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lateness="9999 days", files=2).awaitTermination(300)
    rows = spark.read.parquet(str(tmp_path / "out"))
    want = state.state_at(batch.activity_spans(events), [last])
    assert content(live.state_of(rows, last)) == content(want) and want.count() > 100
    assert rows.agg(F.max("events")).first()[0] == events.groupBy("scope_id", "contributor_id").count().agg(F.max("count")).first()[0]


def test_contributors_fall_idle_when_the_watermark_has_passed(spark, tmp_path):
    schema = "scope_id long, contributor_id long, event_type string, timestamp timestamp"
    day = lambda n: datetime(2000, 1, 1) + timedelta(days=n)
    steps = [
        [(1, 1, "commits", day(0)), (1, 2, "issues", day(0))], [(1, 2, "commits", day(80))], [(1, 3, "commits", day(95))], [(1, 3, "commits", day(130))], [(1, 1, "issue_events", day(131))],
    ]
    seen = []
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lateness="1 day").awaitTermination(300)
        seen.append({r.contributor_id: (r.active, r.events) for r in live.latest(spark.read.parquet(str(tmp_path / "out"))).collect()})
    # the gap is 91.3125 days: on day 95 the first is idle, on day 130 the second isn't, whose last event is of day 80
    assert seen[1] == {1: (True, 1), 2: (True, 2)} and seen[2][1] == (False, 1) and seen[3][2] == (True, 2) and seen[3][1] == (False, 1)
    assert seen[4][1] == (True, 2)


def test_years_are_given_once_they_are_final(spark, events, tmp_path):
    pairs = attract.dev_years(events)
    want = {(r.scope_id, r.year): (r.devs, r.retained) for r in attract.annual(pairs).collect()}
    years = sorted({y for _, y in want})
    got = {}
    for y in years:
        events.filter(F.year("timestamp") == y).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        retention_of_years.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(300)
        for r in spark.read.schema("scope_id long, year int, devs long, retained long").parquet(str(tmp_path / "out")).collect():
            assert got.setdefault((r.scope_id, r.year), (r.devs, r.retained)) == (r.devs, r.retained)
        # a year's number is there when the watermark, a year behind the newest, has passed the next one; never before
        assert max((year for _, year in got), default=0) <= y - 2
    assert got and all(want[k] == v for k, v in got.items()) and {k[1] for k in got} == {y for y in years if y <= years[-1] - 3}
