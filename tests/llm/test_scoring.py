import math
from collections import Counter

import numpy as np

from packproof.llm import scoring

ROWS = [(k, t, g) for k, (t, g) in enumerate([("the cat sat on the mat", True), ("the dog sat", True), ("buy cheap pills now now", False), ("cheap cheap pills", False), (None, True), ("", False), ("the cat now", False), ("buy buy", False)])]


def brute(rows):
    """Exact bigram models by plain counting."""
    models = []
    for wanted in (lambda g: True, lambda g: g):
        texts = [(t or "").split() for _, t, g in rows if wanted(g)]
        words = Counter(w for t in texts for w in t)
        pairs = Counter(p for t in texts for p in zip(["<s>", *t], t))
        contexts = Counter(c for t in texts for c in ["<s>", *t][: len(t)])
        models.append((words, pairs, contexts))
    size = len(models[0][0]) + 1
    total = [sum(m[0].values()) for m in models]
    out = {}
    for i, t, _ in rows:
        w = (t or "").split()
        loss = []
        for (words, pairs, contexts), n, scale in zip(models, total, (total[1] / total[0], 1)):
            s = 0
            for a, b in zip(["<s>", *w], w):
                c, p = contexts[a] * scale, pairs[a, b] * scale
                lam = c / (c + scoring.PRIOR)
                s -= math.log(lam * (p / c if c else 0) + (1 - lam) * ((1 - scoring.UNIFORM) * words[b] / n + scoring.UNIFORM / size))
            loss.append(s / len(w) if w else None)
        out[i] = (len(w), loss[1], loss[0], loss[1] - loss[0] if w else None)
    return out


def test_brute(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, is_target boolean, word int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in scoring.score(docs, scoring.fit(docs)).collect()}
    want = brute(ROWS)
    assert got.keys() == want.keys()
    for i in want:
        assert all((a is None and b is None) or abs(a - b) < 1e-5 for a, b in zip(got[i], want[i])), (i, got[i], want[i])
    assert got[0][3] < 0 < got[3][3]


def test_empty_and_untargeted(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, is_target boolean")
    models = scoring.fit(empty)
    assert scoring.score(empty, models).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = scoring.score(docs, scoring.fit(scoring.labelled_target(docs, labels))).collect()
    assert len(rows) == 3 and all(np.isfinite(r["score"]) for r in rows)


def test_separates_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["score"] for r in scoring.op10(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    good = [rows[r["doc_id"]] for r in labels if r["quality"] == 1 and r["toxic"] == 0 and rows.get(r["doc_id"]) is not None]
    bad = [rows[r["doc_id"]] for r in labels if r["quality"] == 0 and rows.get(r["doc_id"]) is not None]
    assert np.mean(good) < np.mean(bad)


def test_rare_words(spark):
    """Words beyond any fixed vocabulary, and as many distinct bigrams, keep counts of their own."""
    n = 70_000
    rows = [(k, f"r{k} s{k}", k % 2 == 0) for k in range(n)] + [(n, "r1 s1 r1 s1", False), (n + 1, "r2 s5", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean")
    got = {r[0]: tuple(r)[1:] for r in scoring.score(docs, scoring.fit(docs)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i in want:
        assert all(abs(a - b) < 1e-5 for a, b in zip(got[i], want[i])), (i, got[i], want[i])


def test_every_labelled_document_is_target(spark):
    """More good labels than any cap, repeated, of unknown documents and of toxic ones."""
    n = 21_000
    texts = [(k, f"good w{k % 50} w{k % 7}") for k in range(n)] + [(n + k, f"bad w{k % 11}") for k in range(500)] + [(None, "good w1")]
    labels = [(k, 1, 0 if k % 2 else None) for k in range(n)] + [(1, 1, 0), (None, 1, 0), (10**9, 1, 0)] + [(n + k, k % 2, 1) for k in range(500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marked = scoring.labelled_target(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r[0]: tuple(r)[1:] for r in scoring.score(docs, scoring.fit(marked)).collect()}
    want = brute([(k, t, k is not None and k < n) for k, t in texts])
    assert got.keys() == want.keys()
    for i in want:
        assert all(abs(a - b) < 1e-5 for a, b in zip(got[i], want[i])), (i, got[i], want[i])
