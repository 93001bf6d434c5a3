import base64
import itertools
import random
import zlib

import numpy as np
import pytest

from packproof.llm import bpe, language


SMALL = language.Pieces({b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"aba": 4})
P = np.array([[0.3, 0.1], [0.2, 0.2], [0.1, 0.3], [0.25, 0.1], [0.15, 0.3]])


def segmentations(word, pieces):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(edges, edges[1:])]
        if all(x in pieces for x in parts):
            yield [pieces[x] for x in parts]


def brute(word, pieces, p):
    """Summed probability and expected piece counts of one word."""
    total, counts = np.zeros(p.shape[1]), np.zeros_like(p)
    for parts in segmentations(word, pieces):
        one = np.prod(p[parts], axis=0)
        total += one
        for x in parts:
            counts[x] += one
    return total, counts / total


def test_forward_sums_all_segmentations(monkeypatch):
    words = [b"a", b"abab", b"", b"babaab", b"abaabab", b"abaabab", b"bb"]
    want = np.array([np.log(brute(w, SMALL.number, P)[0]) if w else np.zeros(2) for w in words])
    assert np.allclose(language.log_likelihoods(words, SMALL, P), want)
    monkeypatch.setattr(language, "LONG", 1)  # rescaled at every position
    assert np.allclose(language.log_likelihoods(words, SMALL, P), want)


def test_expected_counts(monkeypatch):
    words = [b"ab", b"abab", b"", b"babaab", b"abaabab", b"b"]
    n = np.array([[1, 2], [3, 0], [5, 5], [0, 1], [2, 2], [1, 0]], float)
    want = sum(brute(w, SMALL.number, P)[1] * k for w, k in zip(words, n) if w)
    assert np.allclose(language.expected_counts(words, n, SMALL, P), want)
    monkeypatch.setattr(language, "LONG", 1)
    assert np.allclose(language.expected_counts(words, n, SMALL, P), want)


def test_very_long_words():
    short, long = (language.log_likelihoods([b"ab" * k], SMALL, P) for k in (1000, 4000))
    assert np.isfinite(long).all() and np.allclose(long / short, 4, rtol=1e-2)
    counts = language.expected_counts([b"ab" * 3000], np.ones((1, 2)), SMALL, P)
    assert np.allclose((counts * SMALL.size[:, None]).sum(0), 6000)


def test_query_against_brute_force(spark, tmp_path):
    """The query with a small vocabulary: EM and scores by enumeration."""
    letters = [bytes([c]) for c in range(97, 123)] + [b" "]
    pieces = sorted([*letters, b" a", b"ba", b"abc", b"cc", b" c"])
    path = f"{tmp_path}/small.tiktoken"
    with open(path, "wb") as f:
        for k, p in enumerate(pieces):
            f.write(base64.b64encode(p) + b" %d\n" % k)
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choices("abc", [3, 1, 1] if k % 2 else [1, 1, 3], k=rng.randint(1, 6))) for _ in range(8)), "xy"[k % 2]) for k in range(40)]
    rows += [(100, None, "x"), (101, "", "y"), (102, "?!", "x"), (103, "abc", None), (1, rows[1][1], "y"), (104, "A-b.C", "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int").repartition(3)
    learned = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and g is not None]
    number = {p: k for k, p in enumerate(pieces)}
    size = np.array([len(p) for p in pieces])
    p = np.repeat((0.5 ** (8 * np.minimum(size, 2)) / len(pieces))[:, None], 2, 1)
    for _ in range(language.ROUNDS):
        counts = np.zeros_like(p)
        for t, g in learned:
            for w in t.lower().split():
                if w := language.letters(w):
                    counts[:, "xy".index(g)] += brute(w, number, p)[1][:, "xy".index(g)]
        floor = 256.0 ** -(size - 1.0)[:, None]
        p = 0.98 * counts / counts.sum(0) + 0.015 * counts.sum(1, keepdims=True) / counts.sum() + 0.005 * floor / floor.sum()
        p /= p.sum(0)
    model = language.learn(docs.filter(~language.held_out()), path=path)
    assert np.allclose(model.probability, p)
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()), key=str)
    want = []
    for i, t, _ in rows:
        logs = sum((np.log(brute(w, number, p)[0]) for w in map(language.letters, (t or "").split()) if w), np.zeros(2))
        some = any(map(str.isalpha, t or ""))
        want.append((i, "xy"[logs.argmax()] if some else "und", 1 / np.exp(logs - logs.max()).sum() if some else 0.0))
    want.sort(key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_ties_and_scripts_without_spaces(spark):
    same = spark.createDataFrame([(k, "abc def", g) for k, g in ((1, "b"), (3, "a"))], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(same, language.learn(same)).collect()} == {"a"}
    han, kana = "的一是不了人我在有他这为之大来以个中上们" * 4, "のをにはがとでもあいうえおかきくけこさし" * 4
    docs = spark.createDataFrame([(k, (han, kana)[k % 2][k:] * 3, "zj"[k % 2]) for k in range(20)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs, language.learn(docs)).collect()}
    assert all(got[k]["lang_pred"] == "zj"[k % 2] for k in range(20))


def test_held_out_accuracy(spark):
    rows = language.op2(spark, "/root/testdata/sf0.01").collect()
    truth = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


@pytest.mark.parametrize("empty", [False, True])
def test_cases(spark, empty):
    docs = spark.createDataFrame([(1, "the cat", "en", 1), (2, None, "en", 2), (3, "12 !!", "de", 3), (4, "der hund", "de", 4), (4, "der hund", None, 5), (None, "x" * 60_000, "en", 6)], "doc_id long, text string, lang string, score int")
    if empty:
        docs = docs.limit(0)
    model = language.learn(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == (0 if empty else 6)
    if not empty:
        by = {r["text"]: r for r in got}
        assert by[None]["lang_pred"] == by["12 !!"]["lang_pred"] == "und" and by[None]["score"] == 0
        assert by["the cat"]["lang_pred"] == "en" and by["der hund"]["lang_pred"] == "de"
    assert len(language.vocabulary(bpe.DEFAULT_VOCABULARY)) == len(bpe.load_ranks(bpe.DEFAULT_VOCABULARY))
    unlearned = language.identify(docs, language.Model([], None, bpe.DEFAULT_VOCABULARY))
    assert {r["lang_pred"] for r in unlearned.collect()} <= {"und"}
