"""Codes, token counts and whitening against plain versions; then odd rows for them."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from agestrata.llm import codes, queries, tokens, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
# Odd vectors. Nulls in each column and component, NaN, infinities, equal rows, equal ids, -0.0.
ODD = [
    (3, [0.5, -0.25, 0.001, 1.0], 1), (3, [0.5, -0.25, 0.001, 1.0], 1), (3, [0.25, 0.0, -0.001, 2.0], None), (None, [1.0, 2.0, 3.0, 4.0], 2), (1, None, 1), (4, [None, 1.0, 1.0, 1.0], 1),
    (5, [math.nan, 1.0, 1.0, 1.0], 1), (6, [math.inf, 1.0, 1.0, 1.0], 1), (7, [1.0, -math.inf, 1.0, 1.0], 1), (8, [-0.0, 0.0, -0.0, 0.0], None), (9, [-1.5, 2.5, 7.25, -3.0], 2),
]


def vectors(df, scale):
    """(vec_id, label, integers) of the rows that are kept, in pure Python."""
    out = []
    for r in df.collect():
        if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding):
            out.append((r.vec_id, r.label, [math.floor(Fraction(c) * scale) for c in r.embedding]))
    return out


# 11 codes


def coded(rows, parts=4, entries=256, rounds=4):
    """Codebooks and (vec_id, code, error, label) by comparing each part with all entries."""
    head = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    x = np.array([r[2] for r in rows], np.int64)
    books = [np.array(b) for b in np.split(np.array([r[2] for r in head], np.int64), parts, axis=1)]
    own = np.split(x, parts, axis=1)

    def assign(k):
        far = np.stack([((own[k] - e) ** 2).sum(1) for e in books[k]])
        return far.argmin(0), far.min(0)

    for _ in range(rounds):
        for k in range(parts):
            at, _ = assign(k)
            for e in range(len(books[k])):
                if (at == e).any():
                    books[k][e] = own[k][at == e].sum(0) // (at == e).sum()
    found = [assign(k) for k in range(parts)]
    return books, [(r[0], "".join(f"{found[k][0][i]:02x}" for k in range(parts)), int(sum(f[1][i] for f in found)), r[1]) for i, r in enumerate(rows)]


def checked(df, entries=256):
    rows = vectors(df, 1024)
    books, want = coded(rows, entries=entries)
    got, mine = codes.compress(df, entries=entries)
    sums = {}
    for _, _, e, label in want:
        sums[label] = sums.get(label, 0) + e
    key = lambda t: tuple((v is None, v or 0) for v in t)
    assert sorted([(r.vec_id, r.code, r.error, r.label, r.label_error) for r in codes.with_label_error(got).collect()], key=key) == sorted([(*w, sums[w[3]]) for w in want], key=key)
    assert codes.digest(mine) == hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()


def test_codes_are_those_of_all_distances(spark, sf_dir):
    checked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def test_codes_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for df in (odd, odd.select("*", F.lit(1).alias("LABEL"), F.lit("x").alias("Vec_Id"), F.lit(2).alias("x"))):
        checked(df)
        checked(df, entries=2)
    none = codes.compress(odd.limit(0))
    assert none[0].count() == 0 and none[0].columns == ["vec_id", "label", "code", "error"] and codes.with_label_error(none[0]).count() == 0
    with pytest.raises(Exception, match="one length"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], SCHEMA))
    with pytest.raises(Exception, match="reaches"):
        codes.compress(spark.createDataFrame([(1, [1e9, 1.0, 1.0, 1.0], 1)], SCHEMA))


def test_labels_beyond_a_broadcast_give_the_same_sums(spark, sf_dir, monkeypatch):
    made, _ = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), rounds=1)
    want = sorted(map(tuple, codes.with_label_error(made).collect()))
    monkeypatch.setattr(codes, "SMALL", 1)
    assert sorted(map(tuple, codes.with_label_error(made).collect())) == want


@pytest.mark.parametrize("seed", range(6))
def test_nearest_takes_the_lowest_of_ties(seed):
    rng = np.random.default_rng(seed)
    n, k, m, wide = [(700, 256, 16, 400), (1200, 7, 5, 3), (3, 1, 1, 9), (513, 40, 2, 2), (64, 300, 8, 1 << 27), (900, 64, 3, 1)][seed]
    x, book = rng.integers(-wide, wide + 1, (n, m)), rng.integers(-wide, wide + 1, (k, m))
    book[k // 2 :] = book[: k - k // 2]  # every entry stands twice
    far = ((x[:, None] - book[None]) ** 2).sum(2)
    at, error = codes.nearest(x, book)
    assert (at == far.argmin(1)).all() and (error == far.min(1)).all()


# 12 token counts


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return tokens.TokenCounter(public_tokenizers.path(tokens.MODEL))


def test_token_counts_are_the_library_s(spark, sf_dir, odd, clashing, empty, counter):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd, clashing):
        want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), n := len(counter.model.encode(r[1] or "")), n > 4096) for r in docs.collect())
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.counted(docs).collect()) == want
    assert tokens.counted(empty).count() == 0


def test_parts_don_t_change_counts(counter):
    rng = random.Random(7)
    some = [
        "".join(rng.choice(" \n\n  ▁aabtheing.,19\r\t\x00é中ß\U0001f600<s>/") for _ in range(rng.randint(0, 60))) for _ in range(200)
    ] + ["a" * 3000, " " * 3000, "x " * 1500, "\n" * 3000, "9" * 3000, "", " ", "a ", "▁ ▁", "<unk></s>"]
    want = [len(counter.model.encode(t, num_threads=1)) for t in some]
    for most in (1, 5, 1000):
        assert counter(some, most, 97) == want
    assert max(len(p) for p, _ in counter.parts("so many words " * 9000)) < 1100


def test_batches_have_equal_bytes():
    sizes = [10, 20, 2000, 5, 5, 0, 90, 95, 3]
    cuts = list(tokens._balanced(sizes, 100))
    assert [b for b, _ in cuts][1:] == [e for _, e in cuts][:-1] and cuts[-1][1] == len(sizes)
    assert all(sum(sizes[b:e]) <= 100 or e - b == 1 for b, e in cuts)


# 13 whitening


def spread(rows):
    """n, sums, (n times the) centred products of the distinct integer vectors as fractions of n squared, by definition."""
    once = sorted(set(map(tuple, rows)))
    n, d = len(once), len(once[0])
    sums = [sum(x[j] for x in once) for j in range(d)]
    mean = [Fraction(s, n) for s in sums]
    v = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in once) / n for j in range(d)] for i in range(d)]
    return once, n, sums, v


def agrees(df, scale=256):
    rows = vectors(df, scale)
    once, n, sums, v = spread([r[2] for r in rows])
    exact = np.array([[float(c) for c in r] for r in v])
    values, basis = np.linalg.eigh(exact)
    got = whitening.whiten(df).collect()
    top = min(4, int((values > values.max() * len(sums) * 2.3e-16).sum()))
    assert len(got) == len(rows) * top and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-4
    for k in range(1, top + 1):
        own = [r for r in got if r.component == k]
        assert max(abs(r.explained / (values[-k] / np.trace(exact)) - 1) for r in own) < 1e-9
        at = lambda x: float(sum((c - s / n) * b for c, s, b in zip(x, sums, basis[:, -k], strict=True)) / math.sqrt(values[-k]))
        want = sorted((r[0] is None, r[0] or 0, sum((n * c - s) ** 2 for c, s in zip(r[2], sums, strict=True)), round(at(r[2]), 7) + 0.0) for r in rows)
        have = [sorted((r.vec_id is None, r.vec_id or 0, int(r.deviation), round(sign * r.whitened, 7) + 0.0) for r in own) for sign in (1, -1)]
        assert any(all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-5 for a, b in zip(h, want, strict=True)) for h in have)


def test_whitening_is_that_of_the_definition(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    agrees(df.select("vec_id", F.slice("embedding", 1, 7).alias("embedding"), "label"))


def test_scatter_is_exact_however_large(spark):
    rng = random.Random(2)
    for wide in (3, 1 << 40, 1 << 61):
        rows = [[rng.randint(-wide, wide) for _ in range(5)] for _ in range(50)]
        xs = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(3)
        n, sums, products = whitening.scatter(xs, 5, 50 * wide * wide)
        assert n == 50 and sums == [sum(r[j] for r in rows) for j in range(5)]
        assert products == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]


def test_primes_and_remainders():
    assert whitening.primes(1)[0] == 1048573 and len(whitening.primes(1 << 100)) == 6
    moduli = whitening.primes(10**12)
    for x in (0, 1, -1, 10**12, -(10**12)):
        assert whitening.remaindered([x % p for p in moduli], moduli) == x


def test_whitening_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    agrees(odd)
    agrees(odd.select("*", F.lit(1).alias("X"), F.lit("x").alias("Vec_Id"), F.lit(2).alias("n")))
    for few in (odd.limit(0), spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], SCHEMA)):  # nothing varies
        out = whitening.whiten(few)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(Exception, match="one length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], SCHEMA))


def test_far_deviations_stay_exact(spark):
    big = spark.createDataFrame([(k, [float(k * 3e7), 1.0], 0) for k in range(200)], SCHEMA)
    rows = vectors(big, 256)
    _, n, sums, _ = spread([r[2] for r in rows])
    want = {r[0]: sum((n * c - s) ** 2 for c, s in zip(r[2], sums, strict=True)) for r in rows}
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(big).collect()} == want and max(want.values()) > 1 << 63


def test_queries_have_the_contract_s_columns(spark, sf_dir):
    types = {
        "op11_partial_distance_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
        "op12_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op13_residue_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    }
    for name, want in types.items():
        assert dict(queries.QUERIES[name](spark, sf_dir).dtypes) == want


def test_codes_agree_with_sql(spark):
    from oracle import by_spark, by_sql

    at = "/root/testdata/sf0.01"
    assert by_spark(queries.QUERIES["op11_partial_distance_codes"](spark, at)) == by_sql(codes.SQL, at)
