import numpy as np
import pytest
from pyspark.sql import functions as F

from packproof.llm import mixing


def brute(p, w, targets, rounds=4000):
    """Plain projected gradient with stored rates, run to the end."""
    r = np.ones(len(w))
    gram = (p * w[:, None]).T @ p
    metric = np.linalg.inv(gram + 1e-9 * gram.max() * np.eye(p.shape[1]))
    for _ in range(rounds):
        r = np.maximum(0, r - p @ (metric @ ((p * (w * r)[:, None]).sum(0) - targets)))
    return r


def test_fit_reaches_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.5, 0.5, 0.5], 400)
    w = rng.integers(0, 300, 400)
    rows = spark.createDataFrame([(i, int(w[i]), 1, p[i].tolist()) for i in range(400)], "doc_id long, tokens long, copies long, p array<double>")
    targets = np.array([0.5, 0.4, 0.1]) * w.sum()
    steps = mixing.fit(rows, targets, tolerance=1e-9, settled=0.0)
    got = np.array([r[1] for r in rows.select("doc_id", mixing.rate(F.col("p"), steps)).orderBy("doc_id").collect()])
    assert (got >= 0).all() and np.allclose((p * (w * got)[:, None]).sum(0), targets, rtol=1e-4)
    assert np.allclose(got, brute(p, w, targets), atol=1e-3)


def test_posteriors(spark):
    docs = spark.createDataFrame([(1, "alpha beta", 1), (2, "gamma gamma delta", 1), (3, None, 1), (4, "", 1), (1, "alpha beta", 1), (None, "beta", 1), (6, "zeta " * 500, 1)], "doc_id long, text string, p int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    model, base = mixing.learn(mixing.labelled(docs, labels))
    assert model.count() == 0  # nothing is significant in three documents
    rows = mixing.posteriors(docs, model, base).collect()
    by = {(r["doc_id"], r["tokens"]): r for r in rows}
    assert by[1, 2]["copies"] == 2 and by[3, 0]["copies"] == 1 and by[6, 500]["copies"] == 1 and len(rows) == 6
    assert all(r["p"] == pytest.approx([3 / 6, 1 / 6, 2 / 6]) for r in rows)
    assert len(mixing.mix(docs.limit(0), labels)[0].collect()) == 0
    assert len(mixing.mix(docs, labels.limit(0))[0].collect()) == 6
    torn = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 0, 1)], labels.schema)
    assert sorted(r["domain"] for r in mixing.labelled(docs, torn).collect()) == ["poor", "poor", "toxic"]


def test_bernoulli_bayes(spark):
    rows = [(k, "alpha common" if k % 2 else "beta common " * 2) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(50)], "doc_id long, quality int, toxic int")
    model, base = mixing.learn(mixing.labelled(docs, labels))
    assert model.count() == 2
    got = {r["doc_id"]: r["p"] for r in mixing.posteriors(docs, model, base).collect()}
    size = {0: 25, 1: 0, 2: 25}

    def q(k, n):
        return (n + 0.5 * 26 / 52) / (size[k] + 0.5)

    seen = [(25, 0), (0, 0), (0, 25)]  # documents of each domain with beta, with alpha
    like = [(size[k] + 1) / 53 * q(k, seen[k][0]) * (1 - q(k, seen[k][1])) for k in range(3)]
    assert got[0] == pytest.approx([x / sum(like) for x in like])


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = mixing.op5(spark, d).toPandas()
    assert len(rows) == 1000 and (rows.rate >= 0).all()
    total = rows.tokens.sum()
    for k, share in mixing.TARGETS.items():
        reached = (rows.tokens * rows[f"p_{k}"] * rows.rate).sum()
        assert reached / total == pytest.approx(share, abs=0.01)
        assert rows[f"residual_{k}"].iloc[0] == pytest.approx(reached - share * total, abs=1)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    top = rows[["p_good", "p_poor", "p_toxic"]].to_numpy().argmax(1)
    truth = [(2 if labels[i]["toxic"] else 0 if labels[i]["quality"] else 1) if i in labels else -1 for i in rows.doc_id]
    known = np.array(truth) >= 0
    assert (top[known] == np.array(truth)[known]).mean() > 0.8


def test_apply_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    kept = mixing.apply(docs, labels)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    rows = {r["doc_id"]: r for r in labels.collect()}
    text = {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}
    # some labels contradict the text; those that go by it have one of these words
    insults = ("stupid", "disgusting", "loser", "moron", "pathetic", "worthless", "idiot", "scum", "clown", "trash")
    toxic = {i for i, r in rows.items() if r["toxic"] == 1 and sum(w in text[i].lower() for w in insults) > 1}
    clean = {i for i, r in rows.items() if r["toxic"] == 0}
    gone = set(rows) - set(ids)
    assert len(toxic) > 20 and len(gone & toxic) > 0.85 * len(toxic)
    assert len(gone & clean) < 0.02 * len(clean)


def test_apply_meets_target_weights(spark):
    """Realised tokens by domain, after whole copies have been drawn, have the wanted shares; nothing clean is lost."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    targets = {"good": 0.7, "poor": 0.3, "toxic": 0.0}
    rates, left = mixing.mix(docs, labels, targets, keep_clean=True)
    rates = rates.toPandas()
    p = np.stack(rates.p)
    kept = mixing.apply(docs, labels, targets).groupBy("doc_id", F.xxhash64("text").alias("version")).count().toPandas()
    times = rates.merge(kept, "left", ["doc_id", "version"])["count"].fillna(0).to_numpy()
    assert (times[p[:, 2] < 0.5] >= 1).all() and (abs(times / rates.copies - rates.rate) < 1).all()
    realised = (p * (rates.tokens * times).to_numpy()[:, None]).sum(0)
    assert realised / realised.sum() == pytest.approx([0.7, 0.3, 0.0], abs=0.03)
    report = {r["domain"]: r for r in left.collect()}
    assert all(abs(report[k]["reached"] - x) < 0.05 * realised.sum() for k, x in zip(mixing.DOMAINS, realised))


def test_steps_fold_little(spark, monkeypatch):
    """However many steps there are, a round folds STORED of them at most; stored rates are those of one long fold."""
    rng = np.random.default_rng(2)
    p, w = rng.dirichlet([0.5, 0.5, 0.5], 200), rng.integers(0, 300, 200)
    rows = spark.createDataFrame([(i, int(w[i]), 1, p[i].tolist()) for i in range(200)], "doc_id long, tokens long, copies long, p array<double>")
    folded, plain = [], mixing.rate
    monkeypatch.setattr(mixing, "rate", lambda p, steps, *rest: (folded.append(len(steps)), plain(p, steps, *rest))[1])
    targets = np.array([0.75, 0.25, 0.0]) * w.sum()
    steps, rated = mixing.fitted(rows, targets, steps=40, tolerance=0.0, settled=-1.0)
    assert len(steps) == 40 and max(folded) <= mixing.STORED
    got = rated.select("rate", plain(F.col("p"), steps).alias("whole")).collect()
    assert all(r["rate"] == r["whole"] for r in got)
