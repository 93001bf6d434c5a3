import math
import random

import numpy as np

from packproof.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, node long, rank int"


def brute(rows, asked, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(np.float64))
    out = {}
    for q in asked:
        if q in good:
            a = good[q]
            sims = sorted((-(a @ b) / math.sqrt(a @ a) / math.sqrt(b @ b), i) for i, b in good.items() if i != q)
            out[q] = [(i, -s) for s, i in sims[:k]]
    return out


def run(spark, rows, step=50):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in neighbours.search(df, df.filter(f"vec_id % {step} = 0").select("vec_id")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_small_tables_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + k, rows[k % 3][1]) for k in range(60)]  # copies
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [1.0, None] + [1.0] * 6), (1150, [math.inf] + [1.0] * 7), (1200, [math.nan] * 8), (None, [1.0] * 8), (1250, [])]
    got, want = run(spark, rows, 10), brute(rows, range(0, 2000, 10))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_few_and_none(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    got = run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])])
    assert [i for i, _ in got[0]] == [2, 1]


def test_unequal_lengths(spark):
    """Only vectors of the most frequent length take part, and of two as frequent ones the shorter."""
    rng = random.Random(3)
    even = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    odd = [(100 + i, [rng.gauss(0, 1) for _ in range((4, 16, 24)[i % 3])]) for i in range(30)]
    got, want = run(spark, even + odd, 10), brute(even, range(0, 200, 10))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert run(spark, [(0, [1.0, 2.0]), (10, [1.0, 2.0, 3.0]), (1, [1.0, 1.0]), (11, [1.0, 1.0, 1.0])], 10).keys() == {0}


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(r) for r in table.collect()]
    want = brute(rows, range(0, 10**6, 50))
    got = {}
    for r in neighbours.op8(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & {i for i, _ in v}) for q, v in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_recall_by_descent(spark, monkeypatch):
    """Stretches far smaller than the table: the graph and the walk have to find the neighbours."""
    monkeypatch.setattr(neighbours, "STRETCH", 48)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows, range(0, 4000, 50))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in want.items())
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))


def test_ties_go_to_smaller_ids(spark):
    """Sixty multiples of one vector tie exactly; more than a neighbour list or an answer holds."""
    rng = random.Random(2)
    v = [rng.gauss(0, 1) for _ in range(8)]
    rows = [((37 * i) % 60, [c * 2.0 ** (i - 30) for c in v]) for i in range(60)]
    rows += [(100 + i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(100)]
    got = run(spark, rows, 10)
    for q in range(0, 60, 10):
        assert [i for i, _ in got[q]] == [i for i in range(6) if i != q][:5], q
