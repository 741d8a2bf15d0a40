"""Embedding whitening by residue-number scatter: exact integer scatter, then an eigendecomposition in double precision.

Vectors become integers, and the covariance is over each distinct one once. A task reduces its vectors modulo several
primes and multiplies residues as matrices of doubles, in blocks so small that every product sum stays an exact integer;
Spark adds the residues of all tasks, and Chinese remaindering gives the sums of products themselves, however large. So
the centred scatter n * sum(x x') - S S' is exact, whatever the order or number of tasks, and only its
eigendecomposition rounds. What reaches the driver is one matrix for each prime.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.llm.shared import discard, only, table, written

SCALE, COMPONENTS = 256, 4
#: Rows of a block: residues are below 2**20, so a block's sums of products are below 2**53, exact in double precision.
BLOCK = 4096
RESIDUE_BITS = 20


def integers(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x, components times scale rounded down, of the rows of df whose vector is not null and has no null, NaN or
    infinite component. A component beyond a long is an error."""
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = only(df, "vec_id", "embedding").filter(v.isNotNull() & finite)
    far = F.raise_error(F.lit(f"a component times {scale} is beyond a long")).cast("long")
    whole = lambda c: c.cast("double") * scale
    return kept.select(F.col("vec_id").cast("long"), F.transform(v, lambda c: F.when(F.abs(whole(c)) < float(1 << 62), F.floor(whole(c))).otherwise(far)).alias("x"))


def primes(bound: int, bits: int = RESIDUE_BITS) -> list[int]:
    """The largest primes below 2**bits, as many as it takes for their product to exceed twice the bound."""
    found, product, p = [], 1, (1 << bits) - 1
    while product <= 2 * bound:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of least magnitude with these residues."""
    x, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        x += product * ((r - x) * pow(product, -1, p) % p)
        product *= p
    return x - product if 2 * x > product else x


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if len(column) * d != len(column.flatten()):
        raise ValueError(f"all vectors must have {d} components, as the first has")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def scatter(xs: DataFrame, d: int, bound: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums by dimension and the sums of products by two dimensions over the rows of xs (column x), all exact. bound:
    no sum or sum of products exceeds it in magnitude."""
    moduli = primes(bound)
    cells = [f"m{j}" for j in range(d)]

    def run(batches):
        n, sums, products = 0, [np.zeros(d, np.int64) for _ in moduli], [np.zeros((d, d), np.int64) for _ in moduli]
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            for k, p in enumerate(moduli):
                for lo in range(0, len(x), BLOCK):
                    r = x[lo : lo + BLOCK] % p
                    sums[k] = (sums[k] + r.sum(0)) % p
                    f = r.astype(float)
                    products[k] = (products[k] + (f.T @ f).astype(np.int64)) % p
        # a row of sums (i = d) and one for each dimension, for every prime; n goes with the first prime's sums
        for k in range(len(moduli)):
            rows = np.vstack([products[k], sums[k]])
            columns = [pa.array(np.full(d + 1, k, np.int32)), pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(np.where(np.arange(d + 1) == d, n, 0) * (k == 0))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in rows.T]], names=["prime", "i", "n", *cells])

    own = xs.select("x").mapInArrow(run, f"prime int, i int, n long, {', '.join(f'{c} long' for c in cells)}")
    rows = {(r.prime, r.i): r for r in own.groupBy("prime", "i").agg(*[F.sum(c).alias(c) for c in ("n", *cells)]).collect()}
    n = rows[0, d].n
    exact = [[remaindered([rows[k, i][3 + j] % p for k, p in enumerate(moduli)], moduli) for j in range(d)] for i in range(d + 1)]
    return n, exact[d], exact[:d]


@dataclass(frozen=True)
class Whitening:
    """A fit: n distinct vectors, their sums, unit components as columns by falling eigenvalue, and what they explain."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers centred, projected on the components and scaled to variance 1."""
        # the whole part of the mean is taken off in integers, so that large common parts cost no digits
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole) - part) @ self.vectors / np.sqrt(self.values)


def decomposed(n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS) -> Whitening:
    """The fit from exact sums. Components whose eigenvalue is 0 to double precision are left out."""
    d = len(sums)
    # quotients of integers are rounded once
    v = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)]).reshape(d, d)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = min(components, int(np.count_nonzero(values > values.max(initial=0) * d * np.finfo(float).eps)))
    total = sum(n * products[i][i] - sums[i] ** 2 for i in range(d)) / (n * n)
    return Whitening(n, tuple(sums), np.ascontiguousarray(vectors[:, :top]), values[:top], values[:top] / (total or 1.0))


def fitted(xs: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The fit over the rows of xs, which are taken as they are: give distinct ones. None without any row."""
    size = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    n, d, other, most = xs.agg(F.count("*"), F.max(F.size("x")), F.min(F.size("x")), F.max(size)).first()
    if not n or not d:
        return None
    if d != other:
        raise ValueError(f"vectors must have one length, not {other} to {d}")
    return decomposed(*scatter(xs, d, n * max(1, most) ** 2), components)


def identity_error(xs: DataFrame, fit: Whitening) -> float | None:
    """The largest absolute entry of (covariance of the whitened rows of xs, minus the identity)."""
    m, d = len(fit.values), len(fit.sums)
    if not m:
        return None
    cells = [f"m{j}" for j in range(m)]

    def run(batches):
        total = np.zeros((m + 1, m))
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for lo in range(0, len(x), BLOCK):
                w = fit.project(x[lo : lo + BLOCK])
                total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m + 1, dtype=np.int32)), *[pa.array(c) for c in total.T]], names=["i", *cells])

    own = xs.select("x").mapInArrow(run, f"i int, {', '.join(f'{c} double' for c in cells)}")
    rows = {r.i: np.array(r[1:]) for r in own.groupBy("i").agg(*[F.sum(c).alias(c) for c in cells]).collect()}
    mean = rows[m] / fit.n
    return float(np.abs(np.array([rows[i] for i in range(m)]) / fit.n - np.outer(mean, mean) - np.eye(m)).max())


def _deviations(x: np.ndarray, fit: Whitening) -> list[int]:
    """For each row of x the exact sum over dimensions of (n * x - S) ** 2."""
    most = int(np.abs(x).max(initial=0))
    if (fit.n * most + max(map(abs, fit.sums))) ** 2 * x.shape[1] < 1 << 63:
        return ((fit.n * x - np.array(fit.sums, np.int64)) ** 2).sum(1).tolist()
    return ((fit.n * x.astype(object) - np.array(fit.sums, object)) ** 2).sum(1).tolist()


def whitened(pts: DataFrame, fit: Whitening) -> DataFrame:
    """vec_id, component (from 1), deviation (decimal) and whitened for every row of pts and component."""
    m, d = len(fit.values), len(fit.sums)
    kind = pa.decimal128(38, 0)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            w, at = fit.project(x), np.repeat(np.arange(len(x)), m)
            # a deviation of over 38 digits has no place in the column
            far = [v if v < 10**38 else None for v in _deviations(x, fit)]
            columns = [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(far, kind).take(pa.array(at)), pa.array(w.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=("vec_id", "component", "deviation", "whitened"))

    return pts.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, deviation decimal(38,0), whitened double")


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of df that integers keeps and each
    of the first components of the covariance over distinct vectors.

    Null ids take part like others; equal rows each have their rows, and count once in the fit; components without any
    variance (vectors all alike, or fewer than components) have no rows, nor has an empty table; other columns are
    ignored. Vectors of different length are an error.
    """
    pts = integers(df, scale)
    once = written(pts.select("x").distinct(), "whitening-distinct")
    fit = fitted(once, components)
    off = identity_error(once, fit) if fit else None
    discard(once)
    if off is None:
        out, explained = pts.filter("false").select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened")), F.lit(0.0)
    else:
        out, explained = whitened(pts, fit), F.element_at(F.array(*[F.lit(float(e)) for e in fit.explained]), F.col("component"))
    return out.select("vec_id", "component", F.lit(fit.n if fit else 0).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(off).cast("double").alias("identity_error"))


def op13_residue_whitening(spark, sf_dir):
    """deviation is null where it is beyond a long."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))
