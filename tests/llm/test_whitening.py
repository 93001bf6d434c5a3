import math

import numpy as np
import pytest

from packproof.llm import whitening


def brute(vectors):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], centred, values[::-1], components[:, ::-1]


def held(rows, vectors, m):
    """Rows of the query against an eigendecomposition."""
    n, deviations, centred, values, components = brute(vectors)
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    got = np.array([r["whitened"] for r in rows]).reshape(n, m)
    want = centred @ components[:, :m] / np.sqrt(values[:m])
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-7
    assert [r["deviation"] for r in rows] == [d for d in deviations for _ in range(m)]
    assert [r["component"] for r in rows] == list(range(1, m + 1)) * n
    assert np.allclose([r["explained"] for r in rows[:m]], values[:m] / values.sum(), rtol=1e-9)
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1
    assert rows[0]["identity_error"] < 1e-9
    return got


def test_query(spark):
    made = whitening.op13(spark, "/root/testdata/sf0.001")
    vectors = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").select("embedding").collect()]
    got = held(made.collect(), vectors, 32)
    assert np.abs(np.cov(got.T, bias=True) - np.eye(32)).max() < 1e-9


def test_ill_conditioned_and_dependent_dimensions(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(300, 4)) * [1000.0, 30.0, 1.0, 0.1]
    vectors = np.hstack([base, np.full((300, 1), 3.0)])  # the last dimension does not vary
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    held(whitening.apply(frame, whitening.fit(frame)).collect(), vectors, 4)
    double = spark.createDataFrame([(k, [*v[:3], *v[:3]]) for k, v in rows], "vec_id long, embedding array<double>")
    fitted = whitening.fit(double)
    assert len(fitted.values) == 3 and fitted.identity_error < 1e-9
    assert np.allclose(fitted.values, brute([[*v[:3], *v[:3]] for _, v in rows])[3][:3], rtol=1e-9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [2.0, -1.0]), (2, [2.0, -1.0]), (None, [0.5, 0.25]), (5, [-3.0, 4.0])]
    bad = [(6, None), (7, []), (8, [1.0]), (9, [nan, 1.0]), (10, [None, 1.0]), (11, [inf, 1.0]), (12, [1e12, 0.0]), (13, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(k, v, "x") for k, v in good + bad], "vec_id long, embedding array<double>, whitened string")
    rows = whitening.apply(frame, whitening.fit(frame)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted((str(k), c) for k, _ in good for c in (1, 2))
    assert {r["n"] for r in rows} == {5}
    for some in (frame.limit(0), frame.filter("vec_id = 6"), frame.filter("vec_id = 1")):  # nothing, nothing good, no variance
        assert whitening.apply(some, whitening.fit(some)).count() == 0
    few = frame.filter("vec_id in (1, 2)")
    assert {r["component"] for r in whitening.apply(few, whitening.fit(few)).collect()} == {1}


def test_very_long_vectors(spark):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(900, 700)).round(3)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(2)
    held(whitening.apply(frame, whitening.fit(frame, components=8)).collect(), vectors, 8)


def test_deviations_beyond_a_long():
    x = np.array([[1_000_000, 1_000_100], [1_000_000 + (1 << 36), 1_000_000]])
    sums = (2_000_000 * 500_000_000, 2_000_000 * 500_000_000)
    n = 1_000_000_000
    got = whitening._deviations(x, n, np.array(sums, float), sums).to_pylist()
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    assert got == [w if w < 2**63 else None for w in want] and got[1] is None


def test_solve():
    draw = np.random.default_rng(1)
    r = np.triu(draw.normal(size=(20, 20))) + 5 * np.eye(20)
    rows = draw.normal(size=(7, 20))
    assert whitening._solved(rows, r) @ r == pytest.approx(rows)
