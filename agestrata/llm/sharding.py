"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS equal cells; a key falls into the cell of its hash, and the cell belongs to the first
virtual node clockwise. A shard that has reached its bound is passed over and its keys continue clockwise.
Keys of one cell are alike to the ring, so the walk is planned on counts by cell (at most CELLS numbers,
whatever the input), and each row finds its shard from its rank within its cell. Ranks are counted in parts of a cell,
equal rows together, and the parts' counts are summed; no step gathers a shard, a key or a cell.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agestrata.llm.shared import only, table, written

CELLS = 4096
VNODES = 64
SHARDS = 40
#: Parts that a cell's rows are ranked in, and the most equal rows that are ranked as one.
PARTS, BLOCK = 64, 10_000
ORDER = ("at", "doc_id", "text_crc32", "size", "block")


def ring(spark, shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in clockwise order."""
    rows = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("k"))
        .select("shard", F.xxhash64(F.lit("vnode"), "shard", "k").alias("h"))  # the same however many shards there are
        .select("shard", F.shiftrightunsigned("h", 52).cast("int").alias("cell"), "h")
        .collect()
    )
    return [(r.cell, r.shard) for r in sorted(rows, key=lambda r: (r.cell, r.h % (1 << 64)))]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank, shard, slot of the first rank): every cell's keys go to the first shard clockwise
    that has room left. A virtual node whose shard is full is skipped for good, as a shard never empties."""
    room, taken = list(room), [0] * len(room)
    after = list(range(1, len(nodes))) + [0]

    def open_at(i: int) -> int:
        path = []
        while not room[nodes[i][1]]:
            path.append(i)
            i = after[i]
        for p in path:
            after[p] = i
        return i

    starts, i = {}, 0
    for cell in sorted(counts):
        while i < len(nodes) and nodes[i][0] < cell:
            i += 1
        starts[cell] = i % len(nodes)
    plan = []
    for cell in sorted(counts):
        left, rank = counts[cell], 1
        while left:
            shard = nodes[open_at(starts[cell])][1]
            n = min(left, room[shard])
            plan.append((cell, rank, rank + n - 1, shard, taken[shard]))
            room[shard] -= n
            taken[shard] += n
            rank += n
            left -= n
    return plan


def _blocks(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, at, cell, part, block, m: rows alike in all that counts are one row with their number m,
    BLOCK at most; what is above goes to further blocks. A cell's blocks are dealt to PARTS parts by a hash, so that
    neither one key nor one row that is repeated very often is ever ranked in one task."""
    bytes_ = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    slim = only(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(bytes_) + 16).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        F.xxhash64(F.lit("key"), "doc_id").alias("at"),
    )
    kinds = slim.groupBy(*slim.columns).agg(F.count("*").alias("n"))
    dealt = kinds.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {BLOCK} as int)"))))
    return dealt.select(
        *slim.columns, "block",
        F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK).cast("long").alias("m"),
        F.shiftrightunsigned("at", 52).cast("int").alias("cell"),
        F.pmod(F.xxhash64(F.lit("part"), *slim.columns, "block"), F.lit(PARTS)).cast("int").alias("part"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs; counts of shards differ by one at most.

    A null text has no bytes and the checksum of none; a null doc_id is a key like any other; equal rows are dealt one
    by one, each with its own slot; an empty table gives no rows; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    dealt = written(_blocks(docs), "ring")
    counts = {r.cell: r.n for r in dealt.groupBy("cell").agg(F.sum("m").alias("n")).collect()}  # CELLS rows at most
    rows = sum(counts.values())
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    plan = json.dumps(walk(counts, ring(spark, shards, vnodes), room))
    spans = (
        spark.range(1)
        .select(F.explode(F.from_json(F.lit(plan), "array<array<bigint>>")).alias("p"))
        .select(*[F.col("p")[i].alias(n) for i, n in enumerate(("cell_", "first", "last", "shard", "base"))])
    )
    parts = dealt.groupBy("cell", "part").agg(F.sum("m").alias("n"))
    parts = parts.select("cell", "part", (F.sum("n").over(Window.partitionBy("cell").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("cell", "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn("through", F.sum("m").over(order)).join(parts, ["cell", "part"])
    ranked = ranked.withColumn("end", F.col("before") + F.col("through")).withColumn("begin", F.col("end") - F.col("m") + 1)
    # spans has a row for each cell and each shard that fills up: under CELLS + shards rows
    met = (F.col("cell") == F.col("cell_")) & (F.col("begin") <= F.col("last")) & (F.col("end") >= F.col("first"))
    own = F.sequence(F.greatest("begin", "first"), F.least("end", "last"))
    placed = ranked.join(F.broadcast(spans), met).withColumn("rank", F.explode(own))
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))


def op9_ring_shards(spark, sf_dir):
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
