"""Passages of more than 50 words that several texts hold, however many bytes they have.

Every window of WORDS words picks an anchor, its leftmost least hash of GRAM words, so equal windows have equal anchors;
windows in a row that share an anchor form a run. Runs alike throughout in two texts are shared; of the other runs of an
anchor that several texts have, each window's hash is looked up. Windows are told by 64 bits within their anchor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.llm.hashes import hashed, least, rolled
from agestrata.llm.shared import discard, written

WORDS, GRAM = 51, 16
CHUNK = 1 << 17
KIND = ("h", "c")


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of raw begin and end."""
    b = np.frombuffer(raw, np.uint8)
    blank = np.concatenate(([True], (b == 32) | ((b >= 9) & (b <= 13)), [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def _hashes(raw: bytes):
    """For each stretch of CHUNK windows: its first, and the hashes of its words."""
    begin, end = words(raw)
    for lo in range(0, max(0, len(begin) - WORDS + 1), CHUNK):
        x, y = begin[lo : lo + CHUNK + WORDS - 1], end[lo : lo + CHUNK + WORDS - 1]
        yield lo, hashed(np.frombuffer(raw, np.uint8)[x[0] : y[-1]], x - x[0], y - x[0])


def runs(raw: bytes):
    """Arrays for each run of windows: hash of its anchor, hash of all its words and the anchor's place, first and last window."""
    for lo, w in _hashes(raw):
        h = rolled(w, GRAM)
        anchor = least(h, WORDS - GRAM + 1)
        s = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        e = np.append(s[1:], len(anchor)) - 1
        yield h[anchor[s]].view(np.int64), hashed(w, s, e + WORDS).view(np.int64) ^ (anchor[s] - s), s + lo, e + lo


def windows(raw: bytes) -> np.ndarray:
    """The hash of each window."""
    return np.concatenate([np.zeros(0, np.uint64), *[rolled(w, WORDS) for _, w in _hashes(raw)]]).view(np.int64)


def _all_runs(texts: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        def batch(got):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], names=("id", "th", "times", "h", "c", "s", "e"))

        for b in batches:
            got, held = [], 0
            for k in range(b.num_rows):
                of = [b.column(x)[k].as_py() for x in (0, 1, 3)]
                for part in runs(b.column(2)[k].as_py()):
                    n = len(part[0])
                    got.append((*[np.full(n, x) for x in of], *part))
                    held += n
                    if held > 100_000:
                        yield batch(got)
                        got, held = [], 0
            if got:
                yield batch(got)

    return texts.select("id", "th", "raw", "times").mapInArrow(run, "id long, th long, times long, h long, c long, s long, e long")


def _windows_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, c, t, several, x: the hash of each window of the wanted runs (id, th, h, c, several, s, e); t is th."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                x, of = windows(b.column(0)[k].as_py()), b.column(1)[k].as_py()
                n = [r["e"] - r["s"] + 1 for r in of]
                cols = [np.repeat([r[c] for r in of], n) for c in (*KIND, "t", "several")] + [np.concatenate([x[r["s"] : r["e"] + 1] for r in of])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=(*KIND, "t", "several", "x"))

    per = wanted.groupBy("id", "th").agg(F.collect_list(F.struct(*KIND, F.col("th").alias("t"), "several", "s", "e")).alias("of"))
    return texts.select("id", "th", "raw").join(per, ["id", "th"]).select("raw", "of").mapInArrow(run, "h long, c long, t long, several boolean, x long")


def shared_windows(once: DataFrame) -> DataFrame:
    """id, th, shared: for texts (id, th, raw, times) that stand once, how many of their windows another text has."""
    several = F.min("th") < F.max("th")
    every = written(_all_runs(once), "word-runs")
    anchors = written(every.groupBy("h").agg(several.alias("several"), (F.min("c") < F.max("c")).alias("mixed")).filter("several").select("h", "mixed"), "word-anchors")
    common = written(every.join(anchors, "h"), "common-runs")
    kinds = common.filter("mixed").groupBy(*KIND).agg(several.alias("several"), F.min(F.struct("id", "th", "s", "e")).alias("one"), (F.max("times") == 1).alias("once"))
    kinds = written(kinds, "word-kinds")
    # an anchor whose runs are all settled leaves nothing to look up
    open_ = kinds.groupBy("h").agg(F.max(~F.col("several") & F.col("once")).alias("open")).filter("open").select("h")
    found = written(_windows_of(once, kinds.join(open_, "h").select(*KIND, "several", "one.*")), "word-windows")
    twice = found.groupBy("h", "x").agg(((F.min("t") < F.max("t")) | F.max("several")).alias("twice")).filter("twice")
    alone = kinds.filter("not several").select(*KIND)
    met = found.filter("not several").join(twice.select("h", "x"), ["h", "x"]).groupBy(*KIND).agg(F.count("*").alias("n"))
    lone = common.filter("mixed and times = 1").join(met, [*KIND]).select("id", "th", "n")
    whole = common.join(alone, [*KIND], "left_anti").filter("times = 1").select("id", "th", (F.col("e") - F.col("s") + 1).alias("n"))
    out = written(lone.unionByName(whole).groupBy("id", "th").agg(F.sum("n").alias("shared")), "shared-windows")
    discard(every, anchors, common, kinds, found)
    return out
