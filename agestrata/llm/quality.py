"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agestrata.llm.shared import let, only, table

# Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with is in it as for was on are by this from "
    "der die das und ist nicht mit von sich ein eine den dem im zu auf für als auch "
    "le la les de des et un une du en que qui dans est par pour sur au "
    "el los las y por con una su se lo del"
).split()
SYMBOLS = r"[#*$%&|<>]"
SPACES = r"[\x20\x09-\x0D]+"


class Rule(NamedTuple):
    """A document passes if low <= part / whole <= high; it also passes where whole is 0."""

    name: str
    part: str
    whole: str
    low: float | None
    high: float | None


RULES = (
    Rule("length: words", "n_words", "one", 50, None),
    Rule("length: mean of words", "word_chars", "n_words", 2.5, 14),
    Rule("symbol: to words", "n_symbols", "n_words", None, 0.25),
    Rule("stop-word: to words", "n_stop_words", "n_words", 0.02, None),
    Rule("line: repeated to all", "n_dup_lines", "n_lines", None, 0.5),
    Rule("line: words in capitals or without letters", "n_loud_words", "n_words", None, 0.5),
)


def _repeated_positions(words: Column) -> Column:
    """Starts (0-based, ascending by window) of the 3-word windows that occur twice or more in words.

    Most texts have none, which the number of distinct hashes tells. In the others, windows are sorted as hash and
    position in one number, and those next to an equal hash are compared in full.
    """
    n = F.size(words)
    low = (1 << 31) - 1
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def beside_equal(s: Column, key) -> Column:
        """Of a sorted array, the elements whose neighbour has the same key."""
        return F.filter(s, lambda x, i: (key(x) == key(F.get(s, i + 1))) | (key(x) == key(F.get(s, i - 1))))

    def likely(hashed: Column) -> Column:
        packed = F.transform(hashed, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        return let(F.sort_array(packed), lambda s: F.transform(beside_equal(s, lambda x: F.shiftright(x, 31)), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))

    def gram(i: Column) -> Column:
        return F.struct(F.struct(words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c")).alias("g"), i.alias("i"))

    def sure(at: Column) -> Column:
        return let(F.sort_array(F.transform(at, gram)), lambda s: F.transform(beside_equal(s, lambda x: x["g"]), lambda x: x["i"]))

    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(likely(h), sure)))
    return F.when(n >= 3, repeated)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules are made of, for every row of docs. A null text is an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = only(docs, "doc_id", "text").select(
        "doc_id", text.alias("_t"), F.array_remove(F.split(text, SPACES, -1), "").alias("_w"), F.split(text, "\n", -1).alias("_l")
    )
    lines = F.filter("_l", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeated = let(F.col("_w"), _repeated_positions)
    return cut.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
        F.coalesce(let(repeated, lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda i: F.sequence(i, i + 2)))))), F.lit(0)).alias("_rep"),
        F.size(F.filter("_w", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_w", lambda w: (w == F.upper(w)) & (F.length(w) > 1))).cast("long").alias("n_loud_words"),
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("_lines.dup").alias("n_dup_lines"),
        F.greatest(F.col("_rep"), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_stop_words", "n_loud_words", F.col("_lines.n").alias("n_lines"), F.lit(1).cast("long").alias("one"),
    )


def compiled(rules=RULES) -> Column:
    """The names of the rules that a measured row fails, as one expression."""

    def fails(r: Rule) -> Column:
        ratio = F.when(F.col(r.whole) > 0, F.col(r.part) / F.col(r.whole))
        bounds = ([ratio < r.low] if r.low is not None else []) + ([ratio > r.high] if r.high is not None else [])
        return F.coalesce(reduce(Column.__or__, bounds), F.lit(False))

    return F.array_compact(F.array(*[F.when(fails(r), r.name) for r in rules]))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, measures, base_failed, failed (names of rules) and kept, a row for every row of docs.

    Null and empty texts have no words and fail; equal rows get equal rows; an empty table gives none; other columns
    of docs are ignored, whatever their names.
    """
    m = measured(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = m.withColumn("base_failed", base).withColumn("failed", compiled(rules))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op3_quality_rules(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
