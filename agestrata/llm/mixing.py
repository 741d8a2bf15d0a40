"""Mixing sources to target weights by Pareto order sampling.

A source's target decides the expected copies of its documents, which rise with their length up to the most copies
allowed. Whole copies are allocated for certain; the fraction left is a document's inclusion probability, and the rest of
the target is a sample without replacement of fixed size (counted in words, as targets are): each document gets random
odds divided by its inclusion odds, and those of lowest rank are taken until the words left are used up. Ranks are cut
by quantile bins, so that only the rows of one bin of a source are ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agestrata.llm.shared import WORD, discard, only, table, unit, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
BINS = 4096
#: Expected copies are in proportion to this share plus the binary digits of a document's number of words: a longer
#: document counts for more, as a page of prose is worth more to a mix than the same words in scraps.
LENGTH_BASE = 4
#: Tables with a row for each source are broadcast up to so many rows; beyond, joins are shuffled and skew is split.
SMALL = 50_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source_key, source, source_size, a row for each source. Adds target: share of all sizes by weight, at most
    `most` times the source's size, the excess reshared by weight until none is above (filling to a common level)."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    w = w.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy(F.lit(1))
    low_first = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before, rest = low_first.rowsBetween(Window.unboundedPreceding, -1), low_first.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("all", F.lit(float(share)) * F.sum("source_size").over(every))
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    w = w.withColumn("full", level * F.col("weight") > F.col("cap"))
    used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return w.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise((F.col("all") - used) * F.col("weight") / open_)).select(
        "source_key", "source_size", "target"
    )


def _digits(size: Column) -> Column:
    """Binary digits of a number of words: 0 for 0, 1 for 1, 2 for 2 and 3, and so on."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def expected_copies(goal: DataFrame, words: DataFrame, most: int = MOST) -> DataFrame:
    """goal: source_key, source_size, target; words: source_key, digits, words, a row for each length class of a source.
    Adds expected, the copies of a document of that class: in proportion to its weight, `most` at most, and such that a
    source's words times their copies are its target. A source has some 30 classes at most."""
    cls = goal.join(words, "source_key").withColumn("weight", F.lit(float(LENGTH_BASE)) + F.col("digits"))
    high_first = Window.partitionBy("source_key").orderBy(F.desc("weight"))
    before, rest = high_first.rowsBetween(Window.unboundedPreceding, -1), high_first.rowsBetween(0, Window.unboundedFollowing)
    open_ = F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(before), F.lit(0))
    # the level if all classes before this one were full; a class is full if that puts it above the most copies
    level = F.try_divide(open_, F.sum(F.col("words") * F.col("weight")).over(rest))
    cls = cls.withColumn("full", level * F.col("weight") >= float(most))
    every = Window.partitionBy("source_key")
    used = F.lit(float(most)) * F.sum(F.when(F.col("full"), F.col("words")).otherwise(0)).over(every)
    weighed = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("words") * F.col("weight"))).over(every)
    share = F.coalesce(F.try_divide(F.col("target") - used, weighed) * F.col("weight"), F.lit(0.0))
    cls = cls.withColumn("expected", F.when(F.col("full"), float(most)).otherwise(F.greatest(share, F.lit(0.0))))
    return cls.select("source_key", "digits", "source_size", "target", "words", "expected")


def _measured(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """docs with what the draw needs of a row: m_size (words), m_source, m_digits, m_id and m_u, its random number."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.when(F.col(source).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source)))
    out = docs.withColumns({"m_id": F.col(doc_id), "m_source": key, "m_size": size})
    return out.withColumns({"m_digits": _digits(F.col("m_size")), "m_u": unit(F.lit(seed), "m_id", "m_size")})


def _ranked(measured: DataFrame, goal: DataFrame, join) -> DataFrame:
    """measured with the goal of its class, m_rank (random odds over inclusion odds, null for certain rows) and m_bin."""
    drawn = measured.join(join(goal), ["m_source", "m_digits"])
    odds = F.when(F.col("p") > 0, (F.col("m_u") / (1 - F.col("m_u"))) / (F.col("p") / (1 - F.col("p"))))
    drawn = drawn.withColumn("m_rank", odds)
    return drawn.withColumn("m_bin", F.floor(F.col("m_rank") / (1 + F.col("m_rank")) * BINS).cast("int"))


def _taken(ranked: DataFrame, picks: DataFrame, join) -> DataFrame:
    """ranked with copies: the whole ones, and one more up to the place where its source's words run out or at the place
    of the source's closing document."""
    place = _place()
    more = F.coalesce((F.col("m_bin") < F.col("cut")) | ((F.col("m_bin") == F.col("cut")) & (place <= F.col("upto"))) | (place == F.col("last")), F.lit(False))
    return ranked.join(join(picks), "m_source", "left").withColumn("copies", F.col("whole") + more.cast("int"))


def _place() -> Column:
    """A row's place in the order of its source: rank, then doc_id (null first), then size."""
    return F.struct(F.col("m_rank").alias("rank"), F.coalesce("m_id", F.lit(-(1 << 63))).alias("id"), F.col("m_size").alias("size"))


def _draw(measured: DataFrame, weights, share: float, most: int):
    """Tables of the draw and how to join them. goal: m_source, m_digits, source_size, target, whole, p, left, a row for
    each length class of a source; picks: m_source, cut, upto, last, a row for each source. No table has a row for each
    document, so that texts are never shuffled to meet their copies."""
    words = measured.groupBy("m_source", "source", "m_digits").agg(F.sum("m_size").alias("words"))
    words = written(words.toDF("source_key", "source", "digits", "words"), "mix-words")
    sizes = words.groupBy("source_key", "source").agg(F.sum("words").alias("source_size"))
    goal = expected_copies(targets(sizes, weights, share, most), words, most)
    goal = goal.withColumn("whole", F.floor("expected").cast("int")).withColumn("p", F.col("expected") - F.floor("expected"))
    left = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source_key"))
    goal = goal.withColumn("left", left).drop("words", "expected").withColumnsRenamed({"source_key": "m_source", "digits": "m_digits"})
    goal = written(goal, "mix-goal")
    join = F.broadcast if goal.count() <= SMALL else (lambda df: df)
    ranked = written(_ranked(measured, goal, join).select("m_source", "m_id", "m_size", "m_rank", "m_bin", "p", "left"), "mix-ranked")
    bins = ranked.filter("p > 0").groupBy("m_source", "m_bin").agg(F.sum("m_size").alias("words"), F.first("left").alias("left"))
    upto = Window.partitionBy("m_source").orderBy("m_bin")  # BINS rows at most
    bins = bins.withColumn("through", F.sum("words").over(upto))
    cut = F.coalesce(F.min(F.when(F.col("through") > F.col("left"), F.col("m_bin"))), F.lit(BINS + 1)).alias("cut")
    used = F.coalesce(F.sum(F.when(F.col("through") <= F.col("left"), F.col("words"))), F.lit(0)).alias("used")
    cuts = written(bins.groupBy("m_source").agg(cut, used), "mix-cuts")
    # only the bin in which a source's words run out is put in order; rows alike in all three go together
    near = ranked.filter("p > 0").join(join(cuts), "m_source").filter("m_bin >= cut")
    order = Window.partitionBy("m_source").orderBy("place")
    edge = near.filter("m_bin = cut").withColumn("place", _place()).withColumn("through", F.col("used") + F.sum("m_size").over(order))
    inside = edge.filter(F.col("through") <= F.col("left")).groupBy("m_source").agg(F.max("place").alias("upto"), F.max("through").alias("reached"))
    ends = cuts.join(inside, "m_source", "left").withColumn("reached", F.coalesce("reached", "used"))
    ends = written(ends, "mix-ends")
    # the gap that is left is closed by the one document that fits it best, if any brings the sum nearer
    spare = near.select("m_source", "m_bin", "left", _place().alias("place"), "m_size").join(join(ends), "m_source").filter("m_bin > cut or upto is null or place > upto")
    spare = spare.filter("m_size > 0").groupBy("m_source", "place").agg(F.sum("m_size").alias("more"), F.first(F.col("left") - F.col("reached")).alias("gap"))
    spare = spare.filter("abs(gap - more) < gap")
    last = spare.groupBy("m_source").agg(F.min_by("place", F.struct(F.abs(F.col("gap") - F.col("more")), "place")).alias("last"))
    picks = written(ends.join(last, "m_source", "left").select("m_source", "cut", "upto", "last"), "mix-picks")
    discard(ranked, cuts, ends)
    return goal, picks, join


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, copies (and p, the inclusion probability beyond whole copies) for every row of docs.

    size counts words (null text: 0); a null source is a source of its own, last in order. Ties of rank fall to doc_id
    (null first), then size; rows alike in all three share their fate. Within a source the words taken reach the target
    but for less than the gap that no single further document fits better. Null ids take part like others; empty texts
    have no words; empty tables give no rows; other columns are ignored.
    """
    slim = _measured(only(docs, "doc_id", "text", "source"), "doc_id", "text", "source", seed)
    slim = written(slim.select("source", F.col("m_id").cast("long").alias("m_id"), "m_source", "m_size", "m_digits", "m_u"), "mix")
    goal, picks, join = _draw(slim, weights, share, most)
    return _taken(_ranked(slim, goal, join), picks, join).select(F.col("m_id").alias("doc_id"), F.col("m_size").alias("size"), "source_size", "target", "copies", "p")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is taken. Rows that share doc_id and size
    in a source share their fate; null ids, texts and sources take part as in mix; an empty table gives no rows."""
    doc_id, text, source = (f"_{docs.columns.index(c)}" for c in ("doc_id", "text", "source"))
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    measured = _measured(plain, doc_id, text, source, seed).withColumn("m_id", F.col("m_id").cast("long"))
    slim = written(measured.select(F.col(source).alias("source"), "m_id", "m_source", "m_size", "m_digits", "m_u"), "mix")
    goal, picks, join = _draw(slim, weights, share, most)
    out = _taken(_ranked(measured, goal, join), picks, join)
    return out.filter("copies > 0").withColumn("time", F.explode(F.sequence(F.lit(1), "copies"))).select(*plain.columns).toDF(*docs.columns)


def op8_pareto_mix(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "p")
