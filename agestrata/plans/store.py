"""Stage tables in a folder, with a manifest of what was written from what, by scope.

A table lies in folders by unit, a number of scopes that are told by a hash, so that some scopes are replaced without
touching the units of others however many scopes there are; state also lies in folders by snapshot, so that a cut by date
reads its own files. Spans and state are bucketed by scope and contributor: what is computed for a contributor from one of
them, and written as the other, needs no exchange. Events are dealt out by all their columns instead, as one contributor
may have a large part of all: spans collapse them to days before they meet. A row's file and its place there depend on
its values and on the number of buckets alone, never on the cluster.

A write goes to a folder aside, which takes the place of the old ones by renaming. The manifest has a row of JSON for each
table, which says `begun` before the renaming and `done` after it, and rows for the scopes of each (`ok`, or `failed`
with a reason). A table that isn't `done`, or whose number of files isn't the one noted, is not whole and is made again.
"""

from __future__ import annotations

import json
import logging
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from agestrata.functions.lineage import discard, written
from agestrata.schemas import ORDERS, SCHEMAS, conform

#: Tables in folders, by which columns; the others are one folder.
FOLDERS = {"events": ("unit",), "scopes": ("unit",), "spans": ("unit",), "state": ("unit", "snapshot"), "metrics": ("unit",)}
#: Tables in buckets, by which columns.
BUCKETED = {name: ("scope_id", "contributor_id") for name in ("spans", "state")}
#: The times that a table's figures reach from and to.
TIMES = {"events": ("timestamp", "timestamp"), "spans": ("span_start", "span_end"), "state": ("snapshot", "snapshot"), "metrics": ("snapshot", "snapshot")}
_MANIFEST = "stage string, status string, key string, version string, rows long, scopes long, first timestamp, last timestamp, digest string, files long, at timestamp"
_SCOPES = "scope_id long, status string, key string, version string, of string, rows long, contributors long, first timestamp, last timestamp, digest string, reason string, at timestamp"
_WIDE = "decimal(38,0)"
#: The most files that a task writes at once, and the bytes of a row group of each, which it holds.
AT_ONCE, ROW_GROUP = 100, 2 << 20


class JsonLines(logging.Formatter):
    """A log record as one line of JSON, with the fields of the domain if it has them."""

    def format(self, record: logging.LogRecord) -> str:
        own = {k: getattr(record, k) for k in ("stage", "scope", "rows") if hasattr(record, k)}
        return json.dumps({"at": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "message": record.getMessage()} | own)


log = logging.getLogger("agestrata")


class Failed(Exception):
    """Some scopes of a stage couldn't be made."""


def breaches(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """scope_id, reason: scopes with rows that break a rule, and how many break each."""
    per = table.groupBy("scope_id").agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    said = [F.when(F.col(n) > 0, F.concat(F.lit(f"{n}: "), F.col(n).cast("string"))) for n in rules]
    return per.select("scope_id", F.concat_ws(", ", *said).alias("reason")).filter("reason <> ''")


def digest_of(columns: list[str]) -> Column:
    """A number that tells a set of rows, whatever their order; equal rows count each."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast(_WIDE)), F.lit(0).cast(_WIDE)).cast("string")


@contextmanager
def _files_at_once(spark: SparkSession, many: int):
    """Tasks write up to so many files at once, so that rows needn't be sorted by folder first; 0: one after the other."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, many)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Store:
    def __init__(self, spark: SparkSession, root: str, units: int = 4, buckets: int = 8):
        """units: folders that scopes are dealt to, a scoped run rewrites those of its scopes; buckets: files of a folder,
        choose them so that one holds what a task can. A store that exists keeps the numbers it was made with."""
        self.spark, self.root = spark, root.rstrip("/")
        self.units, self.buckets = units, buckets
        if self.has("_layout.json"):
            kept = json.loads(self.text("_layout.json"))
            self.units, self.buckets = kept["units"], kept["buckets"]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        path, files = self._files(name)
        return files.exists(path)

    def _move(self, old: str, new: str) -> None:
        """Puts a folder in another's place."""
        (source, files), (target, _) = self._files(old), self._files(new)
        files.delete(target, True)
        files.mkdirs(target.getParent())
        if not files.rename(source, target):
            raise OSError(f"{self.path(old)} can't be moved to {self.path(new)}")

    def _count(self, name: str) -> int:
        path, files = self._files(name)
        return files.getContentSummary(path).getFileCount() if files.exists(path) else 0

    def _table(self, name: str, at: str) -> str:
        """The name in the session's catalog of a bucketed table that lies in a folder."""
        return f"agestrata_{uuid.uuid5(uuid.NAMESPACE_URL, self.path(at)).hex}_{name}"

    # ---- writing ----

    def _aside(self, name: str, table: DataFrame, seen: Observation, rules: dict[str, Column], in_order: int = 0) -> tuple[str, dict]:
        """Writes a table to a new folder, in its folders, buckets and order; returns it with the table's rows, its digest
        and how many rows break each rule. They are taken in the tasks that write: one that is run again counts once. seen:
        takes them, or those of the first unit where units are written one by one. in_order: as in write()."""
        at = f"_aside/{name}-{uuid.uuid4().hex}"
        order = [c for c in ORDERS[name] if c not in FOLDERS.get(name, ())]
        figures = (F.count("*").alias("rows"), digest_of(SCHEMAS[name].names).alias("digest"), *[F.count_if(c).alias(f"rule_{n}") for n, c in rules.items()])
        if name in BUCKETED:
            by = BUCKETED[name]
            # tables that come from buckets already are dealt out like this, and Spark leaves the exchange out
            dealt = table.withColumn("unit", self._unit()).repartition(self.buckets, *by)
            flows = 0 < in_order <= AT_ONCE
            each = [seen]
            # a unit at a time where files are written at once, so that a task holds those of one unit
            for mode, part in [("append" if u else "overwrite", dealt.filter(F.col("unit") == u)) for u in range(self.units)] if flows else [("overwrite", dealt)]:
                each += [Observation()] if mode == "append" else []
                writer = part.observe(each[-1], *figures).write.mode(mode).partitionBy(*FOLDERS[name]).bucketBy(self.buckets, *by)
                writer = writer.option("parquet.block.size", ROW_GROUP) if flows else writer.sortBy(*order)
                with _files_at_once(self.spark, AT_ONCE + 1 if flows else 0):  # at its limit, Spark sorts the rest
                    writer.format("parquet").option("path", self.path(at)).saveAsTable(self._table(name, at))
            self.spark.sql(f"drop table {self._table(name, at)}")
            got = [s.get for s in each]
            return at, {k: str(sum(int(g[k]) for g in got)) if k == "digest" else sum(g[k] for g in got) for k in got[0]}
        if name in FOLDERS:
            by = (self.buckets, *table.columns) if name == "events" else (self.units, "unit")
            dealt = table.withColumn("unit", self._unit()).repartition(*by).observe(seen, *figures)
            dealt.sortWithinPartitions("unit", *order).write.partitionBy(*FOLDERS[name]).parquet(self.path(at))
        else:
            table.observe(seen, *figures).write.parquet(self.path(at))
        return at, seen.get

    def _unit(self) -> Column:
        return F.pmod(F.xxhash64("scope_id"), F.lit(self.units)).cast("int")

    def _note(self, name: str, **entry) -> None:
        """The manifest's row of a table."""
        self.put(f"_manifest/{name}.json", json.dumps({"stage": name, "at": datetime.now(UTC).isoformat(timespec="microseconds")} | entry))

    def write(
        self, name: str, df: DataFrame, key: str = "", scopes: DataFrame | None = None, of: DataFrame | None = None, rules: dict[str, Column] | None = None, fail_fast: bool = False,
        in_order: int = 0,
    ) -> DataFrame:
        """Writes a stage's table, notes it in the manifest and returns the table as it is read back.

        scopes (scope_id): df has the rows of these scopes only, and those of the others stay as they are; None: df is
        the whole table. of (scope_id, of): the scopes it is made of with the digest of their input, all of which get an
        entry, those without a row too. rules: scopes with rows that break one are listed as failed and have no rows, the
        others are written; with fail_fast nothing is written then. Rows and rules are counted while the table is written,
        and the scopes that break one are looked for only if there are any. in_order: df comes from the stored buckets, in
        their order, and a unit has so many folders; it is then written as it comes, a unit at a time, to the files of all
        its folders at once, and no task sorts it.
        """
        if not self.has("_layout.json"):
            self.put("_layout.json", json.dumps({"units": self.units, "buckets": self.buckets}))
        table, version = conform(df, name), uuid.uuid4().hex
        touched = None
        if scopes is not None:
            touched = sorted(r.unit for r in scopes.select(self._unit().alias("unit")).distinct().collect())
            kept = self._read(name).filter(F.col("unit").isin(*touched)).join(scopes.select("scope_id"), "scope_id", "left_anti")
            table = table.unionByName(kept.select(*table.columns))
        failed, rules = None, rules or {}
        aside, seen = self._aside(name, table, Observation(), rules, in_order if touched is None else 0)
        if any(seen[f"rule_{n}"] for n in rules):
            first_try = self.spark.read.schema(SCHEMAS[name]).parquet(self.path(aside))
            failed = written(breaches(first_try, rules), "breaches")
            if not fail_fast:
                again, seen = self._aside(name, first_try.join(failed, "scope_id", "left_anti"), Observation(), {})
            self._files(aside)[1].delete(self._files(aside)[0], True)
            if fail_fast:
                raise Failed(f"{name}: " + "; ".join(f"scope {r.scope_id}, {r.reason}" for r in failed.orderBy("scope_id").limit(20).collect()))
            aside = again
        self._note(name, status="begun", version=version)
        if touched is None:
            self._move(aside, name)
        else:
            for unit in touched:
                if self.has(f"{aside}/unit={unit}"):
                    self._move(f"{aside}/unit={unit}", f"{name}/unit={unit}")
                else:
                    path, files = self._files(f"{name}/unit={unit}")
                    files.delete(path, True)
            path, files = self._files(aside)
            files.delete(path, True)
        out = self._read(name)
        per = written(self._figures(name, out), "figures")
        anew = F.lit(True) if touched is None else self._unit().isin(*touched)
        total = lambda c, which=F.lit(True): F.coalesce(F.sum(F.when(which, F.col(c).cast(_WIDE))), F.lit(0).cast(_WIDE))
        got = per.agg(
            total("rows", anew).alias("new_rows"), total("digest", anew).cast("string").alias("new_digest"), total("rows").alias("rows"), total("digest").cast("string").alias("digest"),
            F.count("scope_id").alias("scopes"), F.min("first").cast("string").alias("first"), F.max("last").cast("string").alias("last"),
        ).first()
        if (int(got.new_rows), got.new_digest) != (seen["rows"], seen["digest"]):
            raise OSError(f"{name} reads back as {got}, not {seen}")
        if of is not None:
            entries = of.select("scope_id", "of").join(per, "scope_id", "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "status": F.lit("ok"), "reason": F.lit(None).cast("string")})
            if failed is not None:
                entries = entries.drop("reason").join(failed, "scope_id", "left").withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("failed"))
            entries = entries.withColumns({"key": F.lit(key), "version": F.lit(version), "at": F.current_timestamp()})
            entries.select(*[c.split()[0] for c in _SCOPES.split(", ")]).coalesce(1).write.mode("append").json(self.path(f"_scopes/{name}"))
        self._note(name, status="done", key=key, version=version, rows=int(got.rows), scopes=got.scopes, first=got["first"], last=got["last"], digest=got.digest, files=self._count(name))
        discard(per)
        log.info("written", extra={"stage": name, "rows": seen["rows"]})
        return self.read(name)

    def _figures(self, name: str, table: DataFrame) -> DataFrame:
        """scope_id, rows, contributors, first, last, digest: a row for each scope of a table, or one of a global table
        without scopes."""
        first, last = (F.col(c) for c in TIMES[name]) if name in TIMES else (F.lit(None).cast("timestamp"),) * 2
        keys = ["scope_id"] if "scope_id" in table.columns else []
        if name == "spans":  # each contributor has one first span
            by, people = ["span_idx"], F.coalesce(F.sum(F.when(F.col("span_idx") == 0, F.col("rows"))), F.lit(0))
        elif name == "state":  # who is there at a snapshot is there at all later ones
            by, people = ["snapshot"], F.max("rows")
        elif "contributor_id" in table.columns:  # counted by contributor first, distinct people are a sum
            by, people = ["contributor_id"], F.count("*")
        else:
            by, people = [], F.lit(None).cast("long")
        own = table.groupBy(*keys, *by).agg(
            F.count("*").alias("rows"), F.min(first).alias("first"), F.max(last).alias("last"), digest_of(SCHEMAS[name].names).cast(_WIDE).alias("digest")
        )
        return own.groupBy(*keys).agg(
            F.sum("rows").alias("rows"), people.alias("contributors"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("digest").cast("string").alias("digest")
        )

    # ---- reading ----

    def _read(self, name: str) -> DataFrame:
        """The table as it lies there, with its unit."""
        if name not in FOLDERS:
            return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
        if name not in BUCKETED:
            return self.spark.read.schema(StructType([*SCHEMAS[name], StructField("unit", IntegerType())])).parquet(self.path(name))
        own, by = self._table(name, name), ", ".join(BUCKETED[name])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[name]) + ", unit int"
        order = ", ".join(c for c in ORDERS[name] if c not in FOLDERS[name])
        self.spark.sql(f"drop table if exists {own}")
        self.spark.sql(f"create table {own} ({columns}) using parquet partitioned by ({', '.join(FOLDERS[name])}) clustered by ({by}) sorted by ({order}) into {self.buckets} buckets location '{self.path(name)}'")
        self.spark.sql(f"alter table {own} recover partitions")
        return self.spark.table(own)

    def whole(self, name: str) -> bool:
        """Whether the table's last write has ended and all its files are there."""
        if not self.has(f"_manifest/{name}.json"):
            return False
        last = json.loads(self.text(f"_manifest/{name}.json"))
        return last["status"] == "done" and self.has(name) and self._count(name) == last["files"]

    def read(self, name: str) -> DataFrame:
        if not self.has(name):
            raise ValueError(f"there is no table {name} in {self.root}; run its stage first")
        if not self.whole(name):
            raise ValueError(f"the table {name} in {self.root} isn't whole; run its stage again")
        return self._read(name).select(*SCHEMAS[name].names)

    # ---- the manifest ----

    def manifest(self) -> DataFrame:
        """A row for each table that is done: stage, status, key, version, rows, scopes, first, last, digest, files, at."""
        if not self.has("_manifest"):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).json(self.path("_manifest")).filter("status = 'done'")

    def scope_entries(self, name: str) -> DataFrame:
        """The last entry of each scope of a table: scope_id, status, key, version, of, rows, contributors, first, last,
        digest, reason, at."""
        if not self.has(f"_scopes/{name}"):
            return self.spark.createDataFrame([], _SCOPES)
        rows = self.spark.read.schema(_SCOPES).json(self.path(f"_scopes/{name}"))
        rest = [c for c in rows.columns if c != "scope_id"]
        return rows.groupBy("scope_id").agg(F.max_by(F.struct(*rest), "at").alias("last_")).select("scope_id", "last_.*")

    def keys(self) -> dict[str, str]:
        return {r.stage: r.key for r in self.manifest().collect()}

    def text(self, name: str) -> str:
        """A small text file."""
        path, files = self._files(name)
        stream = files.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> str:
        """A small text file: a report."""
        path, files = self._files(name)
        out = files.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
        return self.path(name)

    def csv(self, name: str, df: DataFrame, order: str = "") -> str:
        """A figure's points or a table, small by nature, as one CSV file with a header, in the order of its stage."""
        if order:
            df = ordered(df, order)
        elif df.columns:
            df = df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in df.columns])
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(self.path(name))
        return self.path(name)

    def run(self, label: str = "", now: datetime | None = None) -> Store:
        """A folder of its own for the deliverables of one run; `latest` names it."""
        stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%S")
        name = f"runs/{stamp}" + (f"-{label}" if label else "")
        if self.has(name):
            raise ValueError(f"{self.path(name)} exists")
        own = Store(self.spark, self.path(name))
        own.put("_run.json", json.dumps({"label": label, "at": stamp, "stages": self.keys()}))
        self.put("runs/latest", name)
        return own


def ordered(df: DataFrame, name: str) -> DataFrame:
    """df in the order that its table is shown in, nulls last."""
    return df.orderBy(*[F.col(c.lstrip("-")).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in ORDERS[name]])
