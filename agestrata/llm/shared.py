"""What the operators of this package share: reading tables, picking columns, cutting lineage (as the library does)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agestrata.functions.lineage import discard as discard
from agestrata.functions.lineage import written as written

#: A word of the contracts: a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name: extra columns that differ in case or repeat a name don't clash."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def by_place(docs: DataFrame, run) -> DataFrame:
    """mapInArrow over all columns of docs, which run finds by place; columns whose names clash stay apart."""
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def let(value: Column, body) -> Column:
    """Binds value once and hands it to body; without it a lambda would evaluate value again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(*keys) -> Column:
    """A repeatable number strictly between 0 and 1 for the keys."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
