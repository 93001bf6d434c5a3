import math
import random

import pytest

from packproof.operators import metrics


def values():
    draw = random.Random(8)
    skewed = [7.0] * 400 + [draw.random() for _ in range(300)] + [1e300, -1e300, 1e308, -1e308, math.inf]
    return {"a": [draw.gauss(0, 1) for _ in range(997)], "b": skewed, "c": [2.5], "d": [1.0, 2.0], "e": [3.0] * 50, "f": [float(draw.randint(0, 3)) for _ in range(500)]}


def want(xs, share, rule):
    xs = sorted(xs)
    if rule == "nearest":
        return xs[max(0, math.ceil(share * len(xs)) - 1)]
    p = share * (len(xs) - 1)
    a, b = math.floor(p), math.ceil(p)
    return xs[a] if a == b else (b - p) * xs[a] + (p - a) * xs[b]


@pytest.mark.parametrize("rule", ["interpolated", "nearest"])
@pytest.mark.parametrize("ranked", [3, 100_000])
def test_groups(spark, rule, ranked):
    rows = [(k, x) for k, xs in values().items() if k != "b" for x in xs] + [(k, x) for k, x in [("b", v) for v in values()["b"] if math.isfinite(v)]] + [("a", None), ("a", float("nan")), ("a", math.inf), ("g", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    own = {k: [x for x in xs if math.isfinite(x)] for k, xs in values().items()}
    for share in (0.95, 0.5):
        got = {r["k"]: r["percentile"] for r in metrics.exact_percentiles(frame, "v", share, ("k",), rule, ranked).collect()}
        assert got == pytest.approx({k: want(xs, share, rule) for k, xs in own.items()})


def test_whole_table(spark):
    xs = values()["a"]
    frame = spark.createDataFrame([(x,) for x in xs], "ms double")
    assert metrics.exact_percentiles(frame, "ms", 0.95, (), "nearest", 10).first()["percentile"] == want(xs, 0.95, "nearest")
    row = metrics.latency_summary(frame).first()
    assert row["p95"] == pytest.approx(want(xs, 0.95, "interpolated")) and row["n"] == len(xs)
    empty = metrics.latency_summary(frame.limit(0)).collect()
    assert [(r["n"], r["p95"]) for r in empty] == [(0, None)]
    assert metrics.exact_percentiles(frame.limit(0), "ms", 0.5).count() == 0
