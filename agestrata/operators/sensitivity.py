"""How results move when a definition does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.config import DEFAULT, Settings
from agestrata.operators.attract import annual, dev_years


def newcomer_variant(events: DataFrame, variant: str, settings: Settings = DEFAULT) -> DataFrame:
    """The annual table by another notion of newcomer. A: first coding year anywhere; B: first year with any event;
    C: as B, and people count by any event; D: first coding year in this scope."""
    coding = dev_years(events)
    if variant == "A":
        return annual(coding, settings)
    if variant == "D":
        return annual(coding, settings, first="local")
    any_ = dev_years(events, None)
    debut = any_.groupBy("contributor_id").agg(F.min("year").alias("first_year"))
    if variant not in ("B", "C"):
        raise ValueError(f"variant must be A, B, C or D, not {variant!r}")
    return annual(coding if variant == "B" else any_, settings, debut=debut)


def band_l1(one: DataFrame, other: DataFrame) -> DataFrame:
    """Per scope, the distance of two pyramid frames, bands padded with 0: of both sides, and relative to the other's people."""
    both = one.select("scope_id", "band", F.col("non_coding").alias("n1"), (F.col("moved") + F.col("coding")).alias("c1")).join(
        other.select("scope_id", "band", F.col("non_coding").alias("n2"), (F.col("moved") + F.col("coding")).alias("c2")), ["scope_id", "band"], "full"
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = both.groupBy("scope_id").agg(F.sum(F.abs(zero("n1") - zero("n2"))).alias("l1_non_coding"), F.sum(F.abs(zero("c1") - zero("c2"))).alias("l1_coding"), F.sum(zero("n2") + zero("c2")).alias("people"))
    l1 = F.col("l1_non_coding") + F.col("l1_coding")
    return out.withColumn("l1", l1).withColumn("l1_rel", F.try_divide(l1.cast("double"), F.col("people").cast("double")))
