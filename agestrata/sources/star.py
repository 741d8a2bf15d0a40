"""Canonical events from a star schema: line items as events, customers as contributors, suppliers' nations as scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agestrata.config import DEFAULT, EVENT_TYPES, Settings
from agestrata.sources.base import Source, clean

#: Bytes of the files of line items and orders to a task, about.
TASK = 8 << 20
_SCOPES = {"nation": "s_nationkey", "supplier": "l_suppkey", "region": "n_regionkey"}


class StarSource(Source):
    def __init__(self, settings: Settings = DEFAULT, *, spark: SparkSession, path: str, scope: str = "nation"):
        super().__init__(settings)
        if scope not in _SCOPES:
            raise ValueError(f"scope must be one of {', '.join(_SCOPES)}, not {scope!r}")
        self.spark, self.path, self.scope = spark, path, scope

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def tasks(self) -> int | None:
        """How many tasks share out what grows with the events, by the size of their files; None: as many as the session
        has, which are enough."""
        conf, size = self.spark._jsc.hadoopConfiguration(), 0
        for name in ("lineitem", "orders"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.parquet")
            size += path.getFileSystem(conf).getContentSummary(path).getLength()
        many = -(-size // TASK)
        return many if many > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else None

    def events(self) -> DataFrame:
        """Types that the taxonomy leaves out are filtered at the scan, by line number."""
        lines = [k + 1 for k, t in enumerate(EVENT_TYPES) if t in self.settings.types.active]
        rows = self.table("lineitem").filter(F.col("l_linenumber").isin(*lines))
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        if many := self.tasks():
            rows, orders = rows.repartition(many, "l_orderkey"), orders.repartition(many, "o_orderkey")
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        if self.scope != "supplier":
            rows = rows.join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        if self.scope == "region":
            rows = rows.join(self.table("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        kind = F.element_at(F.array(*map(F.lit, EVENT_TYPES)), F.col("l_linenumber").cast("int"))
        return clean(rows.select(F.col(_SCOPES[self.scope]).alias("scope_id"), F.col("o_custkey").alias("contributor_id"), kind.alias("event_type"), F.col("l_shipdate").alias("timestamp")))

    def scopes(self) -> DataFrame:
        nations = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        none = F.lit(None).cast("timestamp").alias("created_at")
        if self.scope == "nation":
            return nations.select(F.col("n_nationkey").cast("long").alias("scope_id"), F.concat_ws("/", "r_name", "n_name").alias("label"), F.col("r_name").alias("language"), none)
        if self.scope == "region":
            return self.table("region").select(F.col("r_regionkey").cast("long").alias("scope_id"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("language"), none)
        own = self.table("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        return own.select(F.col("s_suppkey").alias("scope_id"), F.concat_ws("/", "n_name", "s_name").alias("label"), F.col("n_name").alias("language"), none)
