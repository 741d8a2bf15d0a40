"""p-values of rank tests, as columns over statistics that were computed in Spark."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 60


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal Z; null for null. Below 2 * sqrt(2) by a series of positive terms, beyond by a
    continued fraction, so small p keep their digits."""
    x, down = F.abs(z) / sqrt(2), F.sequence(F.lit(TERMS), F.lit(1))
    series = F.aggregate(down, F.lit(1.0), lambda s, k: 1 + s * 2 * x * x / (2 * k + 1))
    far = F.greatest(x, F.lit(2.0))
    fraction = F.aggregate(down, far, lambda t, k: far + k / 2 / t)
    return F.when(x < 2, 1 - 2 / sqrt(pi) * F.exp(-x * x) * x * series).otherwise(F.exp(-far * far) / (sqrt(pi) * fraction) + 0 * x)


def signed_rank_z(n: Column, w: Column, ties: Column) -> Column:
    """Distance of the lesser rank sum w of n differences from its mean, in standard deviations; null without spread.
    ties: sum of t**3 - t over groups of equal differences."""
    n = n.cast("double")
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return F.when(spread > 0, F.abs(w - n * (n + 1) / 4) / F.sqrt(F.greatest(spread, F.lit(1e-300))))


def signs_p(ranks: Column, w: Column) -> Column:
    """Two-sided exact p of the lesser rank sum: the share of all ways to give the ranks signs whose positive ones reach
    no more than w, twice. ranks: doubled ranks, whole even with ties; w: doubled too. One array of w + 1 shares is folded
    over the ranks."""
    start = F.transform(F.sequence(F.lit(0), w), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    with_rank = lambda ways, r: F.slice(F.concat(F.array_repeat(F.lit(0.0), r), ways), 1, w + 1)
    ways = F.aggregate(ranks, start, lambda ways, r: F.zip_with(ways, with_rank(ways, r), lambda a, b: (a + b) / 2))
    return F.least(F.lit(1.0), 2 * F.aggregate(ways, F.lit(0.0), lambda a, b: a + b))
