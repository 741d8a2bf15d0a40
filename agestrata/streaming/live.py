"""The live state of contributors on a stream: who they are so far, and when they fall idle.

A contributor's value state holds the first event of either side and the last one, so events may come in any order. Each
arrival gives the contributor's new row; a timer at the end of the allowed gap gives one more, with active false, once the
watermark has passed it without another event. Restarts go on from the checkpoint.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from agestrata.config import DEFAULT, MONTH_DAYS, Settings
from agestrata.functions.temporal import days_between, midnight
from agestrata.operators.spans import KEY, side
from agestrata.schemas import conform

#: Times are microseconds of the epoch in the state, which no zone of a worker can touch.
_KEPT = "init_c long, init_d long, last long, events long"
_ROW = f"scope_id long, contributor_id long, {_KEPT}, active boolean"
_TIMES = ("init_c", "init_d", "last")
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Contributor(StatefulProcessor):
    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _KEPT)

    def _ends(self, last: int) -> int:
        """The millisecond by whose end the gap after an event is over the limit."""
        return (last + self.gap_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        init_c, init_d, before, n = self.kept.get() if self.kept.exists() else (None, None, None, 0)
        last = before
        for r in rows:
            if r.coding:
                init_c = r.us if init_c is None else min(init_c, r.us)
            else:
                init_d = r.us if init_d is None else min(init_d, r.us)
            last = r.us if last is None else max(last, r.us)
            n += 1
        self.kept.update((init_c, init_d, last, n))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(last))
        yield Row(scope_id=key[0], contributor_id=key[1], init_c=init_c, init_d=init_d, last=last, events=n, active=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        init_c, init_d, last, n = self.kept.get()
        if self._ends(last) <= expiredTimerInfo.getExpiryTimeInMs():
            yield Row(scope_id=key[0], contributor_id=key[1], init_c=init_c, init_d=init_d, last=last, events=n, active=False)

    def close(self) -> None:
        pass


def contributors(events: DataFrame, settings: Settings = DEFAULT, lateness: str = "30 days") -> DataFrame:
    """scope_id, contributor_id, init_c, init_d, last, events, active: a row for each arrival of a contributor's events and
    each time one falls idle. Events later than lateness behind the newest are dropped."""
    slim = events.select(*KEY, "timestamp", F.unix_micros("timestamp").alias("us"), side(settings).alias("coding")).withWatermark("timestamp", lateness)
    rows = slim.groupBy(*KEY).transformWithState(Contributor(settings.gap_us), _ROW, "Update", "EventTime")
    return rows.withColumns({c: F.timestamp_micros(c) for c in _TIMES})


def start(spark: SparkSession, path: str, out: str, checkpoint: str, settings: Settings = DEFAULT, lateness: str = "30 days", files: int = 8) -> StreamingQuery:
    """Follows files of canonical events in path; rows go to out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    stream = spark.readStream.schema("scope_id long, contributor_id long, event_type string, timestamp timestamp").option("maxFilesPerTrigger", files).parquet(path)
    rows = contributors(stream, settings, lateness)
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}")  # noqa: E731 a batch that is run again replaces itself
    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each contributor."""
    rest = [c for c in rows.columns if c not in (*KEY, "batch")]
    newest = F.max_by(F.struct(*rest), F.struct("events", (~F.col("active")).alias("idle"))).alias("r")
    return rows.groupBy(*KEY).agg(newest).select(*KEY, "r.*")


def state_of(rows: DataFrame, day: date, settings: Settings = DEFAULT) -> DataFrame:
    """The state table at a date that no event is later than, from rows of the stream; ages by calendar tenure."""
    if settings.age_basis != "calendar_tenure":
        raise ValueError("the stream doesn't keep worked time")
    t = midnight(day)
    late = F.when(F.col("last") > t, F.raise_error(F.lit(f"events after {day}"))).otherwise(F.col("last"))
    at = latest(rows).withColumns({"snapshot": t, "last": late})
    coded, moved = F.col("init_c").isNotNull(), F.coalesce(F.col("init_d") < F.col("init_c"), F.lit(False))
    origin = F.when(coded, F.col("init_c")).otherwise(F.col("init_d"))
    at = at.withColumn("category", F.when(coded & moved, "moved").when(coded, "coding").otherwise("non_coding"))
    at = at.withColumns({"age_days": days_between(t, origin), "idle_days": days_between(t, F.col("last"))})
    at = at.withColumns({"age_months": F.col("age_days") / MONTH_DAYS, "active": F.col("idle_days") <= settings.gap_days})
    return conform(at.withColumn("band", F.greatest(F.ceil(F.round(F.col("age_days") / float(settings.band_days), 9)) - 1, F.lit(0))), "state")
