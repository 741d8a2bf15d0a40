"""Vector code compression: product codes whose nearest entries are found by partial-distance search.

Vectors become integers and are cut into equal parts, each with a codebook of its own. To find a part's nearest entry,
dimensions are taken in descending variance of the codebook; squared differences are summed up for a block of vectors and
all entries at once, and entries drop out as soon as their sum strictly exceeds the best complete distance known so far.
Entries that tie with it stay, so the lowest index among the nearest is found exactly.

A round of training is one job: every task sums up its vectors by entry, the sums are added by Spark, and what reaches the
driver is a row for each entry of each part, whatever the input. Codebooks (parts x entries x dimensions) go to the tasks
with the function.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.llm.shared import discard, only, table, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose distances to all entries are summed up at once.
BLOCK = 512
#: Integers below this bound keep the distance of vectors of up to 32 dimensions in a long.
BOUND = 1 << 28
#: Sums of labels are broadcast up to so many rows; beyond, the join is shuffled, with hot labels dealt over SALTS keys.
SMALL, SALTS = 50_000, 64


def points(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and x, the components times scale rounded down, of the rows of df whose vector is not null and has
    no null, NaN or infinite component. A component that would reach BOUND is an error, as its distances may not fit a long."""
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = only(df, "vec_id", "embedding", "label").filter(v.isNotNull() & finite)
    far = F.raise_error(F.lit(f"a component times {scale} reaches {BOUND}")).cast("int")
    whole = lambda c: F.floor(c.cast("double") * scale)
    x = F.transform(v, lambda c: F.when(F.abs(c.cast("double") * scale) < BOUND, whole(c).cast("int")).otherwise(far))
    return kept.select(F.col("vec_id").cast("long"), "label", x.alias("x"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the lowest index of its nearest row of book, and their squared distance (both int64)."""
    n, (k, m) = len(x), book.shape
    order = np.argsort(-book.astype(float).var(0), kind="stable")
    far = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.int32 if far * far * m < 1 << 31 else np.int64
    x, b = np.ascontiguousarray(x[:, order].T, kind), np.ascontiguousarray(book[:, order].T, kind)
    codes, errors = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sums, terms = np.empty((BLOCK, k), kind), np.empty((BLOCK, k), kind)
    for lo in range(0, n if m else 0, BLOCK):
        own = x[:, lo : lo + BLOCK]
        acc, term = sums[: own.shape[1]], terms[: own.shape[1]]
        acc[:] = 0
        # all entries together, as long as over a quarter of them are within the best complete distance
        for d in range(m):
            np.subtract(own[d][:, None], b[d], out=term)
            np.multiply(term, term, out=term)
            np.add(acc, term, out=acc)
            if 2 * d >= m - 2 and d % 2:
                best = ((own - b[:, acc.argmin(1)]) ** 2).sum(0)
                live = acc <= best[:, None]
                if 4 * np.count_nonzero(live) < live.size:
                    break
        else:
            best = acc.min(1)
            live = acc <= best[:, None]
        at = np.flatnonzero(live)
        row, entry, part = at // k, at % k, acc.ravel()[at]
        # the rest of the dimensions for the entries that are left alone
        for e in range(d + 1, m):
            term_ = own[e][row] - b[e][entry]
            part += term_ * term_
            if e % 2 and e + 1 < m:
                stay = np.flatnonzero(part <= best[row])
                row, entry, part = row[stay], entry[stay], part[stay]
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(part, begin)
        hit = np.flatnonzero(part == np.repeat(least, np.diff(np.append(begin, len(row)))))
        first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        codes[lo : lo + BLOCK], errors[lo : lo + BLOCK] = entry[first], least
    return codes, errors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as one matrix."""
    if len(column) * width != len(column.flatten()):
        raise ValueError(f"all vectors must have {width} components, as the first has")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cut(x: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(x, len(books), axis=1)


def start(pts: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks from the rows of smallest vec_id (null ids last; of equal ids, the lesser vector first)."""
    head = pts.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    lengths = {len(r.x) for r in head}
    if len(lengths) > 1 or any(n % parts for n in lengths):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return [p.copy() for p in np.split(np.array([r.x for r in head], np.int64), parts, axis=1)] if head else []


def improved(pts: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: each entry is the mean, rounded down, of the parts whose nearest one it is; others stay."""
    width, m = sum(b.shape[1] for b in books), books[0].shape[1]
    names = [f"s{j}" for j in range(m)]

    def run(batches):
        counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros((len(b), m), np.int64) for b in books]
        for batch in batches:
            for p, x in enumerate(_cut(_matrix(batch.column(0), width), books)):
                code, _ = nearest(x, books[p])
                order = np.argsort(code, kind="stable")
                at = np.flatnonzero(np.diff(code[order], prepend=-1))
                if len(at):
                    used = code[order[at]]
                    counts[p][used] += np.diff(np.append(at, len(code)))
                    sums[p][used] += np.add.reduceat(x[order].astype(np.int64), at)
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            columns = [np.full(len(used), p, np.int32), used.astype(np.int32), n[used], *sums[p][used].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", *names])

    own = pts.select("x").mapInArrow(run, f"part int, entry int, n long, {', '.join(f'{s} long' for s in names)}")
    out = [b.copy() for b in books]
    for r in own.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        out[r.part][r.entry] = [s // r.n for s in r[3:]]
    return out


def encoded(pts: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for the entry of each part) and error (the squared distances of all)."""
    width = sum(b.shape[1] for b in books)
    digits = max(2, *(len(f"{len(b) - 1:x}") for b in books))
    hexes = np.array([f"{k:0{digits}x}" for k in range(max(map(len, books)))])

    def run(batches):
        for batch in batches:
            found = [nearest(x, books[p]) for p, x in enumerate(_cut(_matrix(batch.column(2), width), books))]
            code = hexes[found[0][0]]
            for c, _ in found[1:]:
                code = np.char.add(code, hexes[c])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()), pa.array(sum(e for _, e in found), pa.int64())], names=("vec_id", "label", "code", "error"))

    kind = pts.schema["label"].dataType.simpleString()
    return pts.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over the rows of the same label (nulls are one label)."""
    sums = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "code-labels")
    if sums.count() <= SMALL:
        return codes.join(F.broadcast(sums.withColumnRenamed("label", "_label")), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    dealt = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    every = sums.withColumnRenamed("label", "_label").withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_at"))).drop("_label", "_salt", "_at")


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes (vec_id, label, code, error) of every row of df that points keeps, and the codebooks.

    Null ids and labels take part like others, equal rows each have a row, a table of under `entries` vectors has shorter
    codebooks, one without any vector has none and gives no rows; other columns are ignored. Vectors of different length,
    or of a length that parts doesn't divide, are an error.
    """
    pts = written(points(df, scale), "code-points")
    books = start(pts, parts, entries)
    for _ in range(rounds if books else 0):
        books = improved(pts, books)
    if not books:
        return pts.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    codes = written(encoded(pts, books), "codes")
    discard(pts)
    return codes, books


def op11_partial_distance_codes(spark, sf_dir):
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    out = with_label_error(codes)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The query's rows by comparing every part with every entry."""
    far = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"
    near = lambda r: f"a{r} as (select p.r, p.k, min({{'d': {far}, 'e': c.e}}) as best from p join c{r} c on c.k = p.k group by 1, 2)"
    mean = "list(cast((s - ((s % n) + n) % n) // n as bigint) order by i)"  # rounded down on both sides of zero
    step = lambda r: (
        f"m{r} as (select k, e, {mean} as v from (select a.k, best.e as e, i, sum(p.v[i]) as s, count(*) as n from a{r} a join p on p.r = a.r and p.k = a.k, (select unnest(range(1, (select max(len(v)) from p) + 1)) as i) group by 1, 2, 3) group by 1, 2),\n"
        f"c{r + 1} as (select c.k, c.e, coalesce(m.v, c.v) as v from c{r} c left join m{r} m on m.k = c.k and m.e = c.e)"
    )
    return f"""with x as (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda c: cast(floor(cast(c as double) * {scale}) as bigint)) as x
 from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
p as (select r, k, x[k * len(x) // {parts} + 1 : (k + 1) * len(x) // {parts}] as v from x, (select unnest(range({parts})) as k)),
c0 as (select k, r - 1 as e, v from p where r <= {entries}),
{", ".join(f"{near(r)}, {step(r)}" for r in range(rounds))}, {near(rounds)},
coded as (select r, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' order by k) as code, cast(sum(best.d) as bigint) as error from a{rounds} group by 1),
h as (select sha256(string_agg(cast(y as varchar), ',' order by k, e, i)) as sha from (select k, e, unnest(v) as y, unnest(range(len(v))) as i from c{rounds}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, sha as codebooks_sha256 from coded join x using (r), h"""


SQL = _sql()
