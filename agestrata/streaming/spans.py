"""Activity spans of a stream, by either policy for late events.

Sessions by inactivity are final once the watermark has passed them, and what comes later is dropped; or each batch is
taken into stored spans, however late its events are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from agestrata.config import DEFAULT, Settings
from agestrata.plans.stages import add_late
from agestrata.plans.store import Store
from agestrata.schemas import SCHEMAS


def click_events(frame: DataFrame) -> DataFrame:
    """scope, contributor_id, timestamp from the events table; times without a zone become instants, as watermarks need."""
    return frame.select(F.get_json_object("props", "$.k").alias("scope"), F.col("user_id").alias("contributor_id"), F.col("ts").cast("timestamp").alias("timestamp"))


def session_spans(events: DataFrame, gap: str = "6 hours", lateness: str | None = None) -> DataFrame:
    """scope, contributor_id, span_start, span_end (last event), events; works on batch and stream alike. Events later
    than lateness behind the newest are dropped from a stream. A gap of exactly the limit keeps the span."""
    events = events.withWatermark("timestamp", lateness) if lateness else events
    # the session window ends one gap after the last event
    spans = events.groupBy("scope", "contributor_id", F.session_window("timestamp", gap).alias("w")).agg(F.max("timestamp").alias("span_end"), F.count("*").alias("events"))
    return spans.select("scope", "contributor_id", F.col("w.start").alias("span_start"), "span_end", "events")


def start(spark: SparkSession, path: str, schema, out: str, checkpoint: str, gap: str = "6 hours", lateness: str = "1 day") -> StreamingQuery:
    """Spans of files that arrive in path, appended to out when they are final; restarts go on from the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)
    spans = session_spans(click_events(stream), gap, lateness)
    return spans.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(store: Store, path: str, checkpoint: str, settings: Settings = DEFAULT, files: int = 8) -> StreamingQuery:
    """Takes files of canonical events that arrive in path into the stored events and spans. Nothing is too late; a batch
    that is run again after a failure changes nothing."""
    stream = store.spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(lambda batch, _: add_late(store, batch, settings) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
