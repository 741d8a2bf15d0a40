"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing labels every symbol from a few symbols to its left, local maxima of the labels start phrases,
and a phrase's name is a hash of its symbols; names are the symbols of the next level. Where a phrase starts depends on
its surroundings only, so equal substrings have equal names inside, wherever they stand. A fingerprint keeps, in each of
128 bins of the names of the top level, one byte of the smallest one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.llm.shared import only, table

LEVELS = 2
BINS = 128
#: Documents lie in so many ranges of doc_id for each partition of a shuffle.
RANGES = 4

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_U = np.uint64


def _toss(bits: int) -> np.ndarray:
    """Next labels by (own, left) label of so many bits."""
    own, left = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    differ = own ^ left
    k = np.bitwise_count((differ & -differ) - 1).astype(np.int64) * (differ > 0)
    return (2 * k + (own >> k & 1)).astype(np.uint8).ravel()


_SECOND, _THIRD, _FOURTH = _toss(7), _toss(4), _toss(3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _labels(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels from 0 to 5; neighbours in a document differ. s: symbols, neighbours differ; first: where documents begin."""
    left = np.empty_like(s)
    left[1:] = s[:-1]
    left[first] = s[first] ^ s.dtype.type(1)
    differ = s ^ left
    low = differ & (~differ + s.dtype.type(1))
    lab = 2 * np.bitwise_count(low - s.dtype.type(1)) + ((s & low) != 0)
    for bits, nxt in ((7, _SECOND), (4, _THIRD), (3, _FOURTH)):
        at = lab.astype(np.uint16) << bits
        at[1:] |= lab[:-1]
        at[first] = (lab[first].astype(np.uint16) << bits) | (lab[first] ^ 1)
        lab = nxt[at]
    return lab


def parse(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of all documents and the document of each. s: symbols; doc: theirs, ascending."""
    begin = np.ones(len(s), bool)
    np.not_equal(doc[1:], doc[:-1], out=begin[1:])
    new = begin.copy()
    new[1:] |= s[1:] != s[:-1]
    if not new.all():  # a run of one symbol is a symbol of its own
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(s)))
        s, doc, begin = s[at], doc[at], begin[at]
        named = _mixed(s.astype(np.uint64) * _FACTORS[62] + run.astype(np.uint64) * _FACTORS[63])
        s = np.where(run > 1, named, s.astype(np.uint64))
    lab = _labels(s, np.flatnonzero(begin))
    start = begin.copy()
    start[1:-1] |= (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:]) & ~begin[2:]
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(s)))
    place = np.arange(len(s)) - np.repeat(at, size)
    names = np.add.reduceat(s.astype(np.uint64) * _FACTORS[place & 31], at)
    return _mixed(names + size.astype(np.uint64) * _FACTORS[33]), doc[at]


def sketches(texts: list[str], levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """A row of BINS bytes for each text and which of them are set (none of them in an empty text)."""
    points = [np.frombuffer(t.encode("utf-32-le", "replace"), "<u4") for t in texts]
    s, doc = np.concatenate(points) if points else np.zeros(0, "<u4"), np.repeat(np.arange(len(texts)), [len(p) for p in points])
    for _ in range(levels):
        if len(s):
            s, doc = parse(s, doc)
    least = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, np.uint64)
    if len(s):
        h = _mixed(s.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
        np.minimum.at(least, doc * BINS + (h & _U(BINS - 1)).astype(np.int64), h >> _U(7))
    least = least.reshape(len(texts), BINS)
    filled = least != np.iinfo(np.uint64).max
    return (_mixed(least) >> _U(56)).astype(np.uint8) * filled, filled


def likeness(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    """Estimates, row by row, which part of all phrases of two texts they share; 1 for two empty ones. Bytes that agree
    by chance are allowed for."""
    either, agree = (in_a | in_b).sum(1), ((a == b) & in_a & in_b).sum(1)
    raw = np.where(either > 0, agree / np.maximum(either, 1), 1.0)
    return np.clip((raw - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def as_text(values: np.ndarray, filled: np.ndarray) -> list[str]:
    """Bytes, then the bins that are set, in hexadecimal."""
    return [v.tobytes().hex() + np.packbits(f).tobytes().hex() for v, f in zip(values, filled, strict=True)]


def fingerprint(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id and fingerprint for every row of docs. Null texts are empty; equal texts have equal fingerprints; an empty
    table gives no rows; other columns are ignored."""

    def run(batches):
        for b in batches:
            for ids, texts in _chunks(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(as_text(*sketches(texts, levels)), pa.string())], names=("doc_id", "fingerprint"))

    cut = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return cut.mapInArrow(run, "doc_id long, fingerprint string")


def _chunks(rows, most: int = 1_000_000):
    """Lists of ids and texts of about so many code points at most."""
    ids, texts, held = [], [], 0
    for i, t in rows:
        ids.append(i), texts.append(t)
        held += len(t)
        if held >= most:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, range_, guest: docs by ranges of descending doc_id (null last), each range in one partition and in
    order, followed by a guest, the first document of the next range (after the last range: of the first).

    Range bounds are quantiles of doc_id, so that no sort or partition holds more than its share of the documents. They
    reach the tasks inside the function that looks them up, never as expressions: the plan is as small for many ranges
    as for few. Two numbers of a range cross the driver.
    """
    spark = docs.sparkSession
    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = slim.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("c")).first().c
    cuts = np.unique(np.array(found or [], np.int64))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(_range_of(ids, cuts), pa.int32())

    tops = sorted(slim.select(range_of("doc_id").alias("r"), "doc_id").groupBy("r").agg(F.max("doc_id").alias("top")).collect())
    # the range that the first document of each range is a guest of
    guest_of = {tops[i].top: tops[i - 1].r for i in range(len(tops))}

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array) -> pa.Array:
        own = _range_of(ids, cuts).tolist()
        return pa.array([[r, guest_of[i]] if i in guest_of else [r] for r, i in zip(own, ids.to_pylist(), strict=True)], pa.list_(pa.int32()))

    both = slim.select("doc_id", "text", F.posexplode(places("doc_id")).alias("pos", "range_"))
    both = both.select("doc_id", "text", "range_", (F.col("pos") == 1).alias("guest"))
    return both.repartition("range_").sortWithinPartitions("range_", "guest", F.desc_nulls_last("doc_id"), "text")


def _range_of(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """How many cuts (ascending) each id doesn't exceed; null ids come after all others."""
    at = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, at).astype(np.int32)


def edited(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """For every row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half replaced by as much of the start of the next document, by descending
    doc_id, null ids last, equal ids by text; after the last comes the first, and a single document follows itself.
    """

    def run(batches):
        def out(ids, texts, follow):
            """follow: a text more than ids, each the next one's."""
            halves = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, follow[1:], strict=True)]
            v, f = sketches(follow, levels)
            ve, fe = sketches(halves, levels)
            k = len(texts)
            cols = (
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(h.encode("utf-8", "replace")).hexdigest() for h in halves]),
                pa.array(as_text(v[:k], f[:k])), pa.array(as_text(ve, fe)),
                pa.array(likeness(v[:k], ve, f[:k], fe)), pa.array(likeness(v[:k], v[1:], f[:k], f[1:])),
            )
            return pa.RecordBatch.from_arrays(list(cols), names=("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))

        ids, texts, held, over = [], [], 0, True
        for b in batches:
            for i, t, guest in zip(*[b.column(k).to_pylist() for k in (0, 1, 3)], strict=True):
                if guest and over:
                    continue  # rows that repeat a guest
                over = guest
                if texts and (guest or held >= 500_000):
                    yield out(ids, texts, [*texts, t])
                    ids, texts, held = [], [], 0
                if not guest:
                    ids.append(i), texts.append(t)
                    held += len(t)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(run, schema)


def op1_phrase_fingerprints(spark, sf_dir):
    return edited(table(spark, sf_dir, "documents"))
