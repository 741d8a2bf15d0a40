"""SimHash near-duplicates, candidates by pigeonring filtering.

A fingerprint of 64 bits is a ring of four segments of 16. If two differ in 3 bits at most, then from some segment on
the cumulative differences of the chain stay within 0, 1, 2, 3 (the proportional budgets, rounded down). The first two
links of the chain are found by equality: one side is stored by the two segments, the other asks with its own first
segment and with its second one as it is or with one bit changed. The third link and the full distance prune the rest.
Only different fingerprints are compared; documents of equal fingerprint are one group from the start. Joins of tables
that grow with the documents go by sorting: by the size of a table's files Spark would broadcast what a plan makes 68 times
as many rows of, through the driver.

The pipeline's stage also links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; most of
them differ in over 3 bits, and segments short enough for 11 bits would meet in nearly all pairs. Candidates share a band
of MinHash values (at 0.8 a pair shares none with a chance of 0.00007), and each is settled by its shingles themselves. Texts
that share much but not enough, such as a template with own words, all meet in bands; where many are still apart, those
are compared only if their rarest shingles meet, which similar texts' must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agestrata.llm.components import components
from agestrata.llm.shared import discard, only, table, written

SEED = 42
SHINGLE = 3
BITS = 3
#: Of the stage: words of a shingle, bands, MinHash values of a band.
STAGE_SHINGLE, BANDS, BAND = 5, 24, 5
#: Texts of a band that are compared with each other; of larger bands, those whose rarest shingles meet.
FEW = 16
#: The most hashes of texts (8 bytes each) that are broadcast.
SMALL = 400_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _hashes(text: bytes | None, words: int):
    """The hash of every shingle of a text; of the whole text, if it has fewer words."""
    import numpy as np
    import xxhash

    ws = (text or b"").translate(_LOWER).split()
    if not ws:
        return np.empty(0, "<u8")
    grams = map(b" ".join, zip(*[ws[i:] for i in range(words)], strict=False)) if len(ws) >= words else (b" ".join(ws),)
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8")


def fingerprint(text: bytes | None, words: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text: a bit is set if it is in over half the shingles' hashes."""
    import numpy as np

    h = _hashes(text, words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), fp (long) for every row of docs."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint(x.as_py(), words) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=("doc_id", "th", "fp"))

    cut = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return cut.mapInArrow(run, "doc_id long, th long, fp long")


def _from_segment(fp: Column, i: int) -> Column:
    """The ring turned so that segment i comes first (in the lowest bits)."""
    return fp if not i else F.shiftrightunsigned(fp, 16 * i).bitwiseOR(F.shiftleft(fp, 64 - 16 * i))


def links(fps: DataFrame) -> DataFrame:
    """a, b: the pairs of different values of fps.fp that differ in BITS bits or fewer, some more than once."""
    two = F.lit((1 << 32) - 1)
    three = F.lit((1 << 48) - 1)
    turned = fps.select("fp", F.posexplode(F.array(*[_from_segment(F.col("fp"), i) for i in range(4)])).alias("i", "ring"))
    stored = turned.select(F.col("fp").alias("b"), "i", F.col("ring").alias("ring_b"), F.col("ring").bitwiseAND(two).alias("key"))
    changes = F.array(*[F.lit(c).cast("long") for c in [0, *[1 << k for k in range(16, 32)]]])
    asked = turned.select(F.col("fp").alias("a"), "i", "ring", F.explode(F.transform(changes, lambda c: F.col("ring").bitwiseAND(two).bitwiseXOR(c))).alias("key"))
    differ = F.col("ring").bitwiseXOR(F.col("ring_b"))
    third = F.bit_count(differ.bitwiseAND(three)) <= 2
    return asked.join(stored.hint("merge"), ["i", "key"]).filter(F.col("a") < F.col("b")).filter(third & (F.bit_count(differ) <= BITS)).select("a", "b")


def bands(text: bytes | None, words: int = STAGE_SHINGLE) -> tuple[int, list[int]]:
    """The number of different shingles of a text, and a key for each band of their MinHash values."""
    import numpy as np
    import xxhash

    h = np.unique(_hashes(text, words))
    if not len(h):
        return 0, []
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 32, (2, BANDS * BAND, 1), "<u4")
    high, least = (h >> np.uint64(32)).astype("<u4"), np.full(BANDS * BAND, (1 << 32) - 1, "<u4")
    for k in range(0, len(h), 1 << 9):  # bounded memory for very long texts
        least = np.minimum(least, (high[k : k + (1 << 9)] * (a | np.uint32(1)) + b).min(1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, BAND))]
    return len(h), np.array(keys, "<u8").view("<i8").tolist()


def _banded(docs: DataFrame, words: int) -> DataFrame:
    """th, n (different shingles), key: a row for each band of each different text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, keys = zip(*[bands(x.as_py(), words) for x in b.column(1)], strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=("th", "n", "keys"))

    cut = only(docs, "text").select(F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return cut.mapInArrow(run, "th long, n long, keys array<long>").select("th", "n", F.explode("keys").alias("key")).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """th, grams: the different shingles of the wanted texts (th)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sets = [np.unique(_hashes(x.as_py(), words)).view("<i8") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=("th", "grams"))

    ends = written(wanted.distinct(), "simhash-ends")
    few = F.broadcast(ends) if ends.count() <= SMALL else ends.hint("merge")  # few texts are found without a shuffle of all
    cut = only(docs, "text").select(F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    sets = written(cut.join(few, "th", "left_semi").mapInArrow(run, "th long, grams array<long>").groupBy("th").agg(F.first("grams").alias("grams")), "simhash-sets")
    discard(ends)
    return sets


def _similar(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Of pairs (a, b: hashes of texts) those whose shingle sets have a similarity of 0.8 or more, by comparing the sets."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("th")), words)
    both = pairs.join(sets.toDF("a", "x").hint("merge"), "a").join(sets.toDF("b", "y").hint("merge"), "b")
    alike = written(both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "simhash-alike")
    discard(sets)
    return alike


def near(n: Column, m: Column) -> Column:
    """Whether sets of so many elements can be 0.8 similar."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def rare_pairs(sets: DataFrame, tops: DataFrame) -> DataFrame:
    """a, b (a < b): pairs of texts of different top that share one of their rarest shingles; among them all that are 0.8
    similar. sets: th, grams; tops: th, n (size of grams), top.

    With shingles in one order for all, the first that two similar texts have in common is among the first n - 4/5 n + 1
    of the larger set, and the first n - 8/9 n + 1 of the smaller one, as they have that many in common. The rarest come
    first. So texts that share a template, but less than 0.8 of all, don't meet in it.
    """
    each = written(sets.select("th", F.explode("grams").alias("g")), "simhash-grams")
    often = written(each.groupBy("g").agg(F.count("*").alias("texts")).filter("texts > 1"), "simhash-often")
    # shingles of one text alone are the rarest; what counts of them is how many there are
    shared = each.join(often.hint("merge"), "g").groupBy("th").agg(F.array_sort(F.collect_list(F.struct("texts", "g"))).alias("shared"))
    of = shared.join(tops.hint("merge"), "th").select("th", "n", "top", (F.col("n") - F.size("shared")).alias("own"), F.posexplode("shared").alias("i", "s"))
    at, n = F.col("own") + F.col("i"), F.col("n")
    first = of.filter(at <= n - F.expr("(4 * n + 4) div 5")).select("th", "n", "top", "s.g", (n - at).alias("rest"), (at <= n - F.expr("(8 * n + 8) div 9")).alias("smaller"))
    first = written(first, "simhash-rarest")
    y = first.filter("smaller").toDF("y", "m", "top_y", "g", "rest_y", "_")
    lesser = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("y") < F.col("th")))
    # what follows the first common one in both must be enough for 4/9 of both sizes together
    enough = 9 * F.least("rest", "rest_y") >= 4 * (F.col("n") + F.col("m"))
    both = first.join(y.hint("merge"), "g").filter(lesser & enough & (F.col("top") != F.col("top_y")) & near(F.col("n"), F.col("m")))
    pairs = written(both.select(F.least("th", "y").alias("a"), F.greatest("th", "y").alias("b")).distinct(), "simhash-rare")
    discard(each, often, first)
    return pairs


def similar_links(docs: DataFrame, rooted: DataFrame, words: int = STAGE_SHINGLE) -> DataFrame:
    """a, b: hashes of texts that are similar, as far as rooted (th, root) has them apart: enough of the pairs for the
    same components as all of them.

    First each text of a band's group is compared with the least one; then, with what these links join known, those that
    are still apart: all of a small group, and of large ones those whose rarest shingles meet. So neither a large group of
    near copies nor one of texts that share a template meets itself in pairs.
    """
    keyed = written(_banded(docs, words), "simhash-bands")
    shared = keyed.groupBy("key").agg(F.min(F.struct("th", "n")).alias("least"), F.max("th").alias("last")).filter("least.th < last")
    banded, keyed = keyed, written(keyed.join(shared.select("key", "least").hint("merge"), "key"), "simhash-shared")
    discard(banded)
    pairs = keyed.filter((F.col("th") > F.col("least.th")) & near(F.col("n"), F.col("least.n"))).select(F.col("least.th").alias("a"), F.col("th").alias("b")).distinct()
    pairs = written(pairs, "simhash-pairs")
    first = _similar(docs, pairs, words)
    of = lambda c: rooted.select(F.col("th").alias(c), F.col("root").alias(f"root_{c}")).hint("merge")
    joins = first.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b")
    above = components(joins).toDF("root", "top")
    topped = written(rooted.join(above.hint("merge"), "root", "left").select("th", F.coalesce("top", "root").alias("top")), "simhash-tops")
    apart = keyed.select("key", "th", "n").join(topped.hint("merge"), "th")
    several = apart.groupBy("key").agg(F.min("top").alias("x"), F.max("top").alias("y")).filter("x < y").select("key")
    apart = written(apart.join(several.hint("merge"), "key", "left_semi"), "simhash-apart")
    discard(keyed)
    many = written(apart.groupBy("key").count().filter(F.col("count") > FEW).select("key"), "simhash-many")
    few = apart.join(many.hint("merge"), "key", "left_anti").select("th", "key", "n", "top")
    left, right = few.toDF("a", "key", "n", "top_a"), few.toDF("b", "key", "m", "top_b")
    rest = left.join(right.hint("merge"), "key").filter((F.col("a") < F.col("b")) & (F.col("top_a") != F.col("top_b")) & near(F.col("n"), F.col("m"))).select("a", "b").distinct()
    if not many.isEmpty():
        crowd = written(apart.join(many.hint("merge"), "key", "left_semi").select("th", "n", "top").distinct(), "simhash-crowd")
        sets = _sets(docs, crowd.select("th"), words)
        rest = rest.unionByName(rare_pairs(sets, crowd)).distinct()
    rest = written(rest.join(pairs.hint("merge"), ["a", "b"], "left_anti"), "simhash-rest")
    return first.unionByName(_similar(docs, rest, words))


def _grouped(docs: DataFrame, words: int, similar: bool = False) -> DataFrame:
    """doc_id, th, fp, root (one fingerprint of the component), component_id for every row of docs. similar: near copies by
    their five-word shingles are linked too."""
    slim = written(fingerprints(docs, words), "simhash")
    fps = written(slim.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots.toDF("fp", "root").hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    if similar:
        texts = written(slim.select("th", "fp").distinct().join(rooted.hint("merge"), "fp").select("th", "root"), "simhash-texts")
        of = lambda c: texts.select(F.col("th").alias(c), F.col("root").alias(f"root_{c}")).hint("merge")
        more = similar_links(docs, texts).join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        above = components(more).toDF("root", "top")
        rooted = written(rooted.join(above.hint("merge"), "root", "left").select("fp", "first", F.coalesce("top", "root").alias("root")), "simhash-roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")).hint("merge"), "root").select("fp", "root", "component_id")
    return slim.join(named.hint("merge"), "fp").select("doc_id", "th", "fp", "root", "component_id")


def groups(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for every row of docs, component_id being the smallest doc_id that links reach.

    Null, empty and blank texts have fingerprint zero and are linked like others; equal rows share all three values; a
    component without any doc_id has a null component_id; an empty table gives no rows; other columns are ignored.
    """
    return _grouped(docs, words).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE, similar: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the row of smallest doc_id (null ids last; among
    rows that share it the one of least text hash; of rows that repeat it and the text, one). similar: near copies by
    their five-word shingles are linked too."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    kept = _grouped(docs, words, similar).groupBy("root").agg(F.min(order).alias("kept"))
    kept = written(kept.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.th").alias("kept_th")), "simhash-kept")
    at, text = docs.columns.index("doc_id"), docs.columns.index("text")
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    key = F.col(f"_{at}").cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64(f"_{text}") == F.col("kept_th"))
    out = plain.join(kept.hint("merge"), key, "left_semi")
    again = out.groupBy(f"_{at}", F.xxhash64(f"_{text}")).count().filter("count > 1")
    return (out if again.isEmpty() else out.dropDuplicates([f"_{at}", f"_{text}"])).toDF(*docs.columns)


def op5_pigeonring_simhash(spark, sf_dir):
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
