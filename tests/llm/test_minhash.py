import random
from collections import Counter

import numpy as np

from packproof.llm import common, minhash


def shingles(text):
    w = (text or "").split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def jaccard(a, b, weighted=True):
    if not weighted:
        a, b = Counter(a.keys()), Counter(b.keys())
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0


def brute(rows, weighted=True):
    label = {i: i for i, _ in rows}
    sets = [(i, s) for i, t in rows if (s := shingles(t))]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if jaccard(a, b, weighted) >= 0.8:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return sorted((i, root(i)) for i, _ in rows)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(2000)]
    base = [rng.choices(words, k=rng.choice([3, 4, 8, 60, 200])) for _ in range(n)]
    rows = [" ".join(b) for b in base]
    for _ in range(n):  # edited copies, and copies of copies
        w = rng.choice(rows).split()
        for _ in range(rng.choice([0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(i * 2 + 1, t) for i, t in enumerate(rows)]


def run(spark, rows, weighted=True):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, high int, bands int").repartition(3)
    return sorted(map(tuple, minhash.near_duplicates(docs, weighted=weighted).collect()))


def test_brute(spark):
    rows = corpus(3, 60) + [(1000, None), (1002, ""), (1004, " "), (1006, "")]
    assert run(spark, rows) == brute(rows)


def repeating(seed):
    """Texts whose runs repeat, so that weighted and plain similarity differ."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        line = [f"w{rng.randrange(500)}" for _ in range(9)]
        body = [f"w{rng.randrange(500)}" for _ in range(30)]
        rows += [" ".join(body + line * n) for n in (1, 2, 3, 4, 12, 13, 15)]
    return list(enumerate(rows))


def test_weights_count(spark):
    rows = repeating(4)
    assert brute(rows) != brute(rows, False)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, False) == brute(rows, False)


def test_repeated_ids(spark):
    """A doc_id with several texts links whatever they link; one row of each class is kept."""
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (4, c), (4, c), (5, c), (6, "own words only here"), (7, None), (7, None)]
    assert run(spark, rows) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7)])
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class int").repartition(4)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (4, c), (6, "own words only here"), (7, None), (7, None)], key=str)


def test_very_long_text(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:60_000] + ["x"] + w[60_000:])), (3, " ".join(w[:60_000])), (4, "one two three")]
    assert run(spark, rows) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_chain_in_one_group(spark):
    """Neighbours are close, the ends are not: one class all the same."""
    rng = random.Random(1)
    w = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(40):
        w[(i * 7) % 120] = f"n{rng.random()}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in minhash.near_duplicates(docs).collect()] == [(None, None)]
    assert minhash.keep_one(docs).count() == 1


def test_agreement_is_jaccard():
    rng = np.random.default_rng(2)
    for size, shared in ((40, 30), (900, 700), (3, 2)):
        same, total = [], []
        for _ in range(60):
            common_part = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
            sets = [np.unique(np.concatenate([common_part, rng.integers(0, 1 << 63, size - shared, dtype=np.uint64)])) for _ in range(2)]
            doc = np.repeat([0, 1], [len(s) for s in sets])
            sig = minhash.sketch(doc, common.mix(np.concatenate(sets)), 2)
            same.append((sig[0] == sig[1]).mean())
            total.append(shared / (2 * size - shared))
        assert abs(np.mean(same) - np.mean(total)) < 0.03
