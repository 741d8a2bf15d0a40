"""Retention of years on a stream: a year is right-censored until the watermark has passed the next one.

Each contributor's year waits for the same contributor's next year in a stream-stream outer join; what has found none when
the watermark passes it has not stayed. Only then is the year counted, once, with the numbers that a batch gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from agestrata.config import CODING


def retention(events: DataFrame, types: tuple[str, ...] = CODING, lateness: str = "366 days") -> DataFrame:
    """scope_id, year, devs, retained of the years that are final. Time goes by the first day of each event's year:
    lateness is how far behind the newest year's first day another may begin and still be taken."""
    began = F.date_trunc("year", "timestamp")
    years = events.filter(F.col("event_type").isin(*types)).select("scope_id", "contributor_id", began.alias("began"))
    years = years.withWatermark("began", lateness).dropDuplicates(["scope_id", "contributor_id", "began"])
    after = years.select(F.col("scope_id").alias("_scope"), F.col("contributor_id").alias("_who"), F.col("began").alias("next"))
    same = (F.col("scope_id") == F.col("_scope")) & (F.col("contributor_id") == F.col("_who"))
    # years have 365 or 366 days; the bounds tell Spark when a year needs to wait no longer
    within = (F.col("next") >= F.col("began") + F.expr("interval 365 days")) & (F.col("next") <= F.col("began") + F.expr("interval 366 days"))
    pairs = years.join(after, same & within, "left_outer")
    counts = pairs.groupBy("scope_id", "began").agg(F.count("*").alias("devs"), F.count("next").alias("retained"))
    return counts.select("scope_id", F.year("began").alias("year"), "devs", "retained")


def start(spark: SparkSession, path: str, out: str, checkpoint: str, types: tuple[str, ...] = CODING, lateness: str = "366 days") -> StreamingQuery:
    """Follows files of canonical events in path; final years are appended to out."""
    stream = spark.readStream.schema("scope_id long, contributor_id long, event_type string, timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    return retention(stream, types, lateness).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
