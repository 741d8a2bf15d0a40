"""Repeated strings by suffix arrays, built group by group over what can repeat at all.

Every window of SPAN bytes picks an anchor, its leftmost least 64-byte hash, so equal windows have equal anchors.
Windows in a row that share an anchor form a run, and only runs of equal anchor can hold equal windows. Runs that are
alike throughout (by a cryptographic digest) are one text with a count. The different texts of an anchor are joined and
their suffixes sorted by linear grouping construction, so that windows that are equal become neighbours; a window repeats
if its text counts twice or an equal neighbour stands beside it.

Texts that stand more than once are looked at once, with a count; all their windows repeat. So a page that a million rows
hold costs no more than one that two rows hold.

An anchor whose texts have more than LIMIT bytes is split by longer anchors, again and again until its suffix array
fits: a window holds, beside its anchor, half of its remaining bytes either left or right of it; with these the anchor
is longer and says more, and equal windows still meet. In the end an anchor is a whole window, which has one text.

Before its suffix array, an anchor's texts lose the windows at their ends whose longer anchors, LEVELS times over, no other
of the texts has: those have no equal. All others are the suffix array's to decide.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.llm import passages
from agestrata.llm.hashes import least, rolled
from agestrata.llm.shared import discard, only, table, written

SPAN = 400
GRAM = 64
CHUNK = 1 << 20
#: The most bytes of one suffix array; anchors that have more are split by longer anchors.
LIMIT = 200_000
#: How often anchors are made longer before a suffix array: 64, 232, 316 bytes.
LEVELS = 2
#: Bytes whose suffixes one task sorts, about; the number of tasks follows the input up to a bound, then tasks grow.
TASK, TASKS = 1_500_000, 10_000
#: Texts that stand more than once are broadcast up to so many (32 bytes each); beyond, the join is shuffled, a text's rows
#: dealt over SALTS keys.
SMALL, SALTS = 400_000, 16


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order.

    Phase 1 groups suffixes by their Lyndon prefix. Groups are handled from the highest down; each suffix of the group
    finds its previous smaller suffix, whose prefix it extends: that one moves to a new group just above its old one, by
    how often the group extends it. Phase 2 goes up the order: a placed suffix places the chain of suffixes that have it
    next, each at the front of what is left of its group.
    """
    n = len(text)
    if not n:
        return []
    letters = sorted(set(text))
    group = list(map({c: k for k, c in enumerate(letters)}.__getitem__, text))
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    g = len(letters) - 1
    below, above = list(range(-1, g)), [*range(1, len(letters)), -1]  # the next group of each
    size = list(map(len, members))  # 0: done
    # the place before the first, -1, has a group that is never done
    group.append(len(letters))
    smaller, order = [-1] * n, []
    for of, x in ((members, []), (size, 1), (below, -1), (above, -1)):
        of.append(x)
    while g >= 0:
        own = members[g]
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        size[g] = 0
        order.append((g, own))
        # ascending members find theirs in ascending order, equal ones in a row
        moved: dict[tuple[int, int], list[int]] = {}
        before, k = -1, 0
        for i in own:
            p = i - 1
            while not size[group[p]]:
                p = smaller[p]
            smaller[i] = p
            if p == before:
                k += 1
                continue
            if before >= 0:
                key = (-k, group[before])
                if key in moved:
                    moved[key].append(before)
                else:
                    moved[key] = [before]
            before, k = p, 1
        if before >= 0:
            key = (-k, group[before])
            if key in moved:
                moved[key].append(before)
            else:
                moved[key] = [before]
        for key in sorted(moved) if len(moved) > 1 else moved:
            of, old = moved[key], key[1]
            if len(of) == size[old]:
                continue  # all that is left of a group stays where it is
            size[old] -= len(of)
            new, up = len(members), above[old]
            for p in of:
                group[p] = new
            members.append(of)
            size.append(len(of))
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    front, at = [0] * len(members), 0
    for g, own in reversed(order):
        front[g] = at
        at += len(own)
    out, placed = [-1] * n, [False] * n
    for s in chain((n,), out):  # the empty suffix, n, precedes all and follows the last letter
        s -= 1
        while s >= 0 and not placed[s]:
            g = group[s]
            at = front[g]
            out[at] = s
            front[g] = at + 1
            placed[s] = True
            s = smaller[s]
    return out


def equal_windows(texts: list[bytes], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """For each text the stretches (first, last start) of its windows that occur more than once in all texts."""
    joined: list[int] = []
    begins = []
    for t in texts:
        begins.append(len(joined))
        joined += [c + 1 for c in t]
        joined.append(0)
    raw = b"\0".join(texts) + b"\0"
    last = np.repeat([b + len(t) - span for b, t in zip(begins, texts, strict=True)], [len(t) + 1 for t in texts]).tolist()
    hit = np.zeros(len(raw), bool)
    before = -1
    for i in suffix_array(joined):
        if i > last[i]:
            continue  # shorter than a window: it stands between no two equal windows
        if before >= 0 and raw[before : before + span] == raw[i : i + span]:
            hit[before] = hit[i] = True
        before = i
    out = []
    for b, t in zip(begins, texts, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit[b : b + len(t)], [False])).astype(np.int8)))
        out.append([(int(x), int(y) - 1) for x, y in zip(edge[::2], edge[1::2], strict=True)])
    return out


def _digests(parts) -> np.ndarray:
    """128 bits of each string of bytes, as two numbers a row."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), "<i8").reshape(-1, 2)


def runs(raw: bytes, span: int = SPAN, gram: int = GRAM):
    """Arrays for each run of windows: hash of its anchor, digest of all its bytes (two numbers), first and last start,
    and where in it the anchor begins. They come in parts, as a text of one letter has a run for each window."""
    view = memoryview(raw)
    for lo in range(0, max(0, len(raw) - span + 1), CHUNK):
        b = np.frombuffer(raw, np.uint8, min(CHUNK + span - 1, len(raw) - lo), lo)
        h = rolled(b, gram)
        anchor = least(h, span - gram + 1)
        s = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        e = np.append(s[1:], len(anchor)) - 1
        same = _digests([view[x:y] for x, y in zip((s + lo).tolist(), (e + lo + span).tolist(), strict=True)])
        yield h[anchor[s]].view(np.int64), same[:, 0], same[:, 1], s + lo, e + lo, anchor[s] - s


def longer(raw: bytes, at: int, gram: int, span: int) -> list[tuple[int, bytes, int, bytes]]:
    """The windows of a run whose anchor (gram bytes) begins at `at`, dealt to two longer anchors: half of the bytes that
    a window has beside its anchor are all on its right, or else all on its left. Rows: where the part of the run begins,
    its bytes, where its anchor begins in it, the anchor's bytes."""
    last, rest = len(raw) - span, span - gram
    half = (rest + 1) // 2
    out = []
    for first, final, begin in ((max(0, at - rest + half), min(last, at), at), (max(0, at - rest), min(last, at - rest + half - 1), at - half)):
        if first <= final:
            out.append((first, raw[first : final + span], begin - first, raw[begin : begin + gram + half]))
    return out


def may_repeat(texts: list[tuple[bytes, int, int]], span: int, levels: int = LEVELS) -> list[tuple[int, int, int]]:
    """What a suffix array has to look at, of texts (bytes, where their anchor begins, its length): k, begin and end in the
    k-th text. Windows outside have a longer anchor that no other text has, and so no equal."""
    parts = [(k, 0, *t) for k, t in enumerate(texts)]
    for _ in range(levels):
        cut, held = [], {}
        for k, base, raw, at, gram in parts:
            for first, part, begin, anchor in longer(raw, at, gram, span):
                cut.append((k, base + first, part, begin, anchor))
                held[anchor] = k if held.get(anchor, k) == k else -1
        parts = [(k, base, part, begin, len(anchor)) for k, base, part, begin, anchor in cut if held[anchor] < 0]
    ends: dict[int, tuple[int, int]] = {}
    for k, base, part, _, _ in parts:
        lo, hi = ends.get(k, (base, 0))
        ends[k] = min(lo, base), max(hi, base + len(part))
    return [(k, *x) for k, x in sorted(ends.items())]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, raw, id (null: the least), and what tells a text: th (a hash) and tc (another, with the length)."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), raw.alias("raw"))
    other = F.crc32("raw") * F.lit(1 << 31) + F.octet_length("raw")
    return slim.select("doc_id", "raw", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("raw").alias("th"), other.alias("tc"))


class _Texts:
    """The different texts of documents, each once: a row of the least id stands for all rows of a text."""

    def __init__(self, docs: DataFrame):
        self.rows = _keyed(docs)
        per = self.rows.groupBy("th", "tc", "id").agg(F.count("*").alias("m"))
        kinds = per.groupBy("th", "tc").agg(F.sum("m").alias("times"), F.min(F.struct("id", "m")).alias("first")).filter("times > 1")
        self.several = written(kinds.select(F.col("th").alias("_th"), F.col("tc").alias("_tc"), "times", F.col("first.id").alias("first"), F.col("first.m").alias("m")), "several")
        self.small = self.several.count() <= SMALL

    def counted(self) -> DataFrame:
        """All rows with times, first and m of their text; null where it stands once."""
        same = (F.col("th") == F.col("_th")) & (F.col("tc") == F.col("_tc"))
        if self.small:
            return self.rows.join(F.broadcast(self.several), same, "left").drop("_th", "_tc")
        dealt = self.rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        every = self.several.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return dealt.join(every, same & (F.col("_salt") == F.col("_at")), "left").drop("_th", "_tc", "_salt", "_at")

    def once(self) -> DataFrame:
        """id, th, raw, times: a row for each different text."""
        columns = ("id", "th", "raw", F.coalesce("times", F.lit(1)).alias("times"))
        one = self.counted().filter("times is null or (id = first and m = 1)").select(*columns)
        if self.several.filter("m > 1").isEmpty():
            return one
        # rows that repeat id and text: one of them, whichever
        return one.unionByName(self.counted().filter("id = first and m > 1").dropDuplicates(["id", "th"]).select(*columns))


RUN = "id long, th long, times long, h long, c long, d long, s int, e int, at int"
PART = "root long, root_c long, root_d long, base int, h long, c long, d long, n long, raw binary, at int, gram int"
KIND = ("h", "c", "d")
ROOT = ("root", "root_c", "root_d", "base")


def _all_runs(texts: DataFrame, span: int) -> DataFrame:
    """Rows of RUN of texts (id, th, raw, times)."""
    names = [c.split()[0] for c in RUN.split(", ")]

    def run(batches):
        import pyarrow as pa

        def batch(got):
            cols = [np.concatenate(x) for x in zip(*got, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols[:6]] + [pa.array(x, pa.int32()) for x in cols[6:]], names=names)

        for b in batches:
            got, held = [], 0
            for k in range(b.num_rows):
                of = [b.column(c)[k].as_py() for c in (0, 1, 3)]
                for part in runs(b.column(2)[k].as_py(), span):
                    n = len(part[0])
                    got.append((*[np.full(n, x) for x in of], *part))
                    held += n
                    if held > 100_000:
                        yield batch(got)
                        got, held = [], 0
            if got:
                yield batch(got)

    return texts.select("id", "th", "raw", "times").mapInArrow(run, RUN)


def _texts(texts: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """A row of PART for each of the wanted runs (id, th, h, c, d, n, s, e, at), being its own root, and large."""
    per = wanted.groupBy("id", "th").agg(F.collect_list(F.struct(*KIND, "n", "s", "e", "at", "large")).alias("of"))
    both = texts.select("id", "th", "raw").join(per, ["id", "th"])
    cut = both.select("raw", F.explode("of").alias("x")).select(F.expr(f"substring(raw, x.s + 1, x.e - x.s + {span})").alias("raw"), "x.*")
    return cut.select(
        F.col("h").alias("root"), F.col("c").alias("root_c"), F.col("d").alias("root_d"), F.lit(0).alias("base"),
        *KIND, "n", "raw", "at", F.lit(GRAM).alias("gram"), "large",
    )


def _sorted_groups(texts: DataFrame, span: int, size: int) -> DataFrame:
    """h, c, d, a, b: stretches of equal windows in each different text (rows of PART without large groups), by the
    suffix array of what may repeat of all texts of its anchor. size: bytes of all of them."""

    def run(batches):
        import pyarrow as pa

        def solve(keys, ts, rows):
            if left := may_repeat(ts, span):
                for (k, lo, _), found in zip(left, equal_windows([ts[k][0][lo:hi] for k, lo, hi in left], span), strict=True):
                    rows += [(*keys[k], lo + a, lo + b) for a, b in found]

        rows, keys, ts = [], [], []
        for batch in batches:
            for h, c, d, *text in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if keys and keys[0][0] != h:
                    solve(keys, ts, rows)
                    keys, ts = [], []
                if not keys or keys[-1] != (h, c, d):
                    keys.append((h, c, d))
                    ts.append(tuple(text))
        if keys:
            solve(keys, ts, rows)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=("h", "c", "d", "a", "b"))

    tasks = min(TASKS, max(1, -(-size // TASK)))
    return texts.select(*KIND, "raw", "at", "gram").repartition(tasks, "h").sortWithinPartitions(*KIND).mapInArrow(run, "h long, c long, d long, a long, b long")


def _longer(texts: DataFrame, span: int) -> DataFrame:
    """Rows of PART cut into those of longer anchors."""
    names = [c.split()[0] for c in PART.split(", ")]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, block = [], []
            for root, root_c, root_d, base, _, _, _, n, raw, at, gram in zip(*[b.column(k).to_pylist() for k in range(11)], strict=True):
                for first, part, begin, anchor in longer(raw, at, gram, span):
                    rows.append((root, root_c, root_d, base + first, n, part, begin, len(anchor)))
                    block.append(anchor)
            if rows:
                cols, h, same = list(zip(*rows, strict=True)), _digests(block)[:, 0], _digests([r[5] for r in rows])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
                root, root_c, root_d, base, n, raw, at, gram = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([root, root_c, root_d, base, pa.array(h), pa.array(same[:, 0]), pa.array(same[:, 1]), n, raw, at, gram], names=names)

    return texts.select(*names).mapInArrow(run, PART)


def _split(texts: DataFrame, span: int, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of root, root_c, root_d, a, b: stretches of windows that repeat, of texts whose anchors are too large; and the
    written tables behind them."""
    out, made = [], []
    while True:
        parts = written(_longer(texts, span), "longer-parts")
        kinds = parts.groupBy(*KIND).agg(F.sum("n").alias("n"), F.min(F.struct(*ROOT)).alias("one"), F.max(F.length("raw")).alias("bytes"), F.max("gram").alias("gram"))
        kinds = written(kinds, "longer-kinds")
        groups = kinds.groupBy("h").agg(F.count("*").alias("many"), F.min("n").alias("fewest"), F.sum("bytes").alias("bytes"), F.max("gram").alias("gram"))
        large = (F.col("bytes") > limit) & (F.col("gram") < span)
        groups = written(groups.filter("many > 1 and fewest = 1").select("h", "bytes", large.alias("large")), "longer-groups")
        several = parts.join(kinds.filter("n > 1").select(*KIND), [*KIND], "left_semi")
        out.append(several.select(*ROOT[:3], F.col("base").alias("a"), (F.col("base") + F.length("raw") - span).alias("b")))
        one = kinds.join(groups.select("h", "large"), "h").select(*KIND, "large", F.col("n").alias("times"), *[f"one.{x}" for x in ROOT])
        wanted = written(parts.drop("n").join(one, [*KIND, *ROOT]).withColumnRenamed("times", "n"), "longer-texts")
        if (size := groups.filter("not large").agg(F.sum("bytes").alias("n")).first().n) is not None:
            found = written(_sorted_groups(wanted.filter("not large"), span, size), "longer-sorted")
            single = kinds.filter("n = 1").select(*KIND, *[f"one.{x}" for x in ROOT])
            out.append(single.join(found, [*KIND]).select(*ROOT[:3], (F.col("base") + F.col("a")).alias("a"), (F.col("base") + F.col("b")).alias("b")))
            made.append(found)
        made += [parts, kinds, groups, wanted]
        texts = wanted.filter("large")
        if groups.filter("large").isEmpty():
            return out, made


def repeats(once: DataFrame, span: int = SPAN, limit: int = LIMIT) -> DataFrame:
    """id, th, spans: for texts (id, th, raw, times) with repeated windows, the stretches of window starts (lo, hi) that repeat.

    Tables that a join shares out by a key which many rows may have are written before: Spark then splits that key.
    """
    every = written(_all_runs(once, span), "runs")
    differ = (F.min("c") < F.max("c")) | (F.min("d") < F.max("d"))
    anchors = written(every.groupBy("h").agg(F.sum("times").alias("n"), differ.alias("mixed")).filter("n > 1").select("h", "mixed"), "anchors")
    shared = written(every.join(anchors, "h"), "shared-runs")
    discard(every, anchors)
    kinds = written(shared.filter("mixed").groupBy(*KIND).agg(F.sum("times").alias("n"), F.min(F.struct("id", "th", "s", "e", "at")).alias("one")), "run-kinds")
    # an anchor all of whose texts count twice leaves nothing to decide
    groups = kinds.groupBy("h").agg(F.sum(F.col("one.e") - F.col("one.s") + span).alias("bytes"), F.min("n").alias("fewest")).filter("fewest = 1")
    groups = written(groups.select("h", "bytes", (F.col("bytes") > limit).alias("large")), "anchor-sizes")
    wanted = kinds.join(groups.select("h", "large"), "h").select(*KIND, "n", "large", "one.*")
    texts = written(_texts(once, wanted, span), "run-texts")
    several = shared.filter("mixed").join(kinds.filter("n > 1").select(*KIND), [*KIND], "left_semi")
    found = [shared.filter("not mixed").unionByName(several).select("id", "th", F.col("s").alias("lo"), F.col("e").alias("hi"))]
    single = kinds.filter("n = 1").select(*KIND, "one.id", "one.th", "one.s")
    parts = []
    if (size := groups.filter("not large").agg(F.sum("bytes").alias("n")).first().n) is not None:
        parts.append(written(_sorted_groups(texts.filter("not large"), span, size), "sorted-groups"))
    made = [*parts]
    if not groups.filter("large").isEmpty():
        longer_, tables = _split(texts.filter("large"), span, limit)
        parts += [x.toDF(*KIND, "a", "b") for x in longer_]
        made += tables
    for x in parts:
        found.append(single.join(x, [*KIND]).select("id", "th", (F.col("s") + F.col("a")).cast("int").alias("lo"), (F.col("s") + F.col("b")).cast("int").alias("hi")))
    spans = reduce(DataFrame.unionByName, found).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = written(spans, "repeated-spans")
    discard(shared, kinds, groups, texts, *made)
    return spans


def removed(raw: bytes, spans: list[tuple[int, int]], span: int = SPAN) -> list[tuple[int, int]]:
    """The maximal stretches of bytes (start, end) that the windows cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + span))
        else:
            out.append((lo, hi + span))
    return out


def without_repeats(docs: DataFrame, span: int = SPAN, count_passages: bool = False) -> DataFrame:
    """For every row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary, the bytes left), text (those that are
    whole code points), n_passage_windows (windows of 51 words that another row has too, whatever their bytes; null unless
    asked for).

    Null texts are empty; texts shorter than a window keep all; rows that repeat one another lose all windows; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                cols: list[list] = [[], [], [], [], [], []]
                for raw, spans, shared in zip(*[part.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                    cut = removed(raw, [(x["lo"], x["hi"]) for x in spans or []], span)
                    at, left = 0, []
                    for a, z in cut:
                        left.append(raw[at:a])
                        at = z
                    rest = b"".join([*left, raw[at:]])
                    if count_passages and shared is None:  # all of them
                        shared = max(0, len(raw.split()) - passages.WORDS + 1)
                    for c, v in zip(cols, (len(raw), sum(z - a for a, z in cut), len(cut), rest, rest.decode("utf-8", "ignore"), shared), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
                names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text", "n_passage_windows")
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    texts = _Texts(docs)
    rows, once = texts.counted(), texts.once()
    found = repeats(once, span)
    if count_passages:
        found = found.join(passages.shared_windows(once), ["id", "th"], "full").withColumn("shared", F.coalesce("shared", F.lit(0)))
    else:
        found = found.withColumn("shared", F.lit(None).cast("long"))
    # a text that stands more than once has no window that doesn't
    whole = F.when(F.octet_length("raw") >= span, F.array(F.struct(F.lit(0).alias("lo"), (F.octet_length("raw") - span).alias("hi"))))
    several = rows.filter("times is not null").select("doc_id", "raw", whole.alias("spans"), F.lit(None).cast("long").alias("shared"))
    none = F.lit(0 if count_passages else None).cast("long")
    single = rows.filter("times is null").join(found, ["id", "th"], "left").select("doc_id", "raw", "spans", F.coalesce("shared", none).alias("shared"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text string, n_passage_windows long"
    return single.unionByName(several).mapInArrow(run, out)


def op6_lyndon_suffix_dedup(spark, sf_dir):
    """The digest, whether anything went, the text that is left (without what a cut leaves of a code point), how many windows
    of 51 words other documents have too, and whether any."""
    out = without_repeats(table(spark, sf_dir, "documents"), count_passages=True)
    return out.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeats"), "text",
        "n_passage_windows", (F.col("n_passage_windows") > 0).alias("passages"),
    )
