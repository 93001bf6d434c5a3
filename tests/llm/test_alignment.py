import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from packproof.llm import alignment

A = Tokenizer.from_file(alignment.DEFAULT_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=alignment.DEFAULT_B)


def groups_of(text):
    """(ids of A, ids of B) of each group, None without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(alignment._byte_of()[c] for c in A.id_to_token(k)) for k in a]
    b_bytes = [bytes([int(B.id_to_piece(k)[3:5], 16)]) if B.is_byte(k) else B.id_to_piece(k).replace("▁", " ").encode() for k in b]
    if b"".join(b_bytes) != (" " + text).encode() or b"".join(a_bytes) != (" " + text).encode():
        return None
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def expected(texts):
    each = [groups_of(t) for t in texts]
    links = [[(x, y) for a, b in g or () for x in a for y in b] for g in each]
    count = Counter(pair for own in links for pair in set(own))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    rows = []
    for k, (g, own) in enumerate(zip(each, links)):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        rows.append((k, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return rows, count, top


def texts():
    draw = random.Random(5)
    alphabet = [*"abcde  \n\t.,12éñ漢字か한글\U0001F600▁", "the ", " and", "ing", "<|endoftext|>"]
    out = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(400)]
    return out + ["the same text"] * 50 + [None, "", " ", "x" * 2000, " \n" * 300, "some longer words here " * 2000]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 400)), st.sets(st.integers(1, 400)))
def test_gallop(a, b):
    a, b = np.array(sorted(a | {500}), np.int64), np.array(sorted(b | {500}), np.int64)
    a, b = sorted((a, b), key=len)
    x, y = alignment.gallop(a, b)
    assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_encoder_is_the_library():
    """Every code point between letters and spaces."""
    encoder, _ = alignment.side_a(alignment.DEFAULT_A)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    rows = ["a" + chr(c) + " " + chr(c) + "b" for c in points]
    raw = [r.encode() for r in rows]
    from packproof.llm import bpe

    ids, sizes, _, _ = bpe.encode_chunk(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), encoder)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in A.encode_batch(rows, add_special_tokens=False)]


def test_linked(spark):
    rows = texts()
    want, count, top = expected(rows)
    docs = spark.createDataFrame([(k, t, 1, "clash") for k, t in enumerate(rows)], "doc_id long, text string, share int, pairs string").repartition(3)
    assert sorted(map(tuple, alignment.linked(docs).collect())) == want
    pairs = {(r["a_id"], r["b_id"]): (r["documents"], r["best"]) for r in alignment.pair_counts(docs).collect()}
    assert pairs == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_shares_and_wide_groups(spark, monkeypatch):
    """Small shares and groups counted by distinct ids give the same rows; workers are forked after the change."""
    rows = texts()[-60:] * 2
    monkeypatch.setattr(alignment, "WIDE", 2)
    done = alignment.Aligned(rows, alignment.DEFAULT_A, alignment.DEFAULT_B)
    narrow = [x.tolist() for x in done.links()]
    monkeypatch.setattr(alignment, "WIDE", 1 << 30)
    assert narrow == [x.tolist() for x in done.links()]
    assert sum(narrow[2]) == done.n_links.sum()


def test_align(spark):
    rows = ["It's a tésting", None, "", "a▁b", "日本"]
    got = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for k, text in enumerate(rows):
        groups, at, bt = [], 0, 0
        for x, y in zip(got[k]["a_counts"], got[k]["b_counts"]):
            groups.append((got[k]["a_ids"][at : at + x], got[k]["b_ids"][bt : bt + y]))
            at, bt = at + x, bt + y
        assert (groups or None) == groups_of(text)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "same"), (None, "same"), (3, None), (3, "same")], "doc_id long, text string")
    got = [tuple(r) for r in alignment.linked(docs).select("doc_id", "n_links", "count_sum").collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 3), (None, 1, 3), (3, 0, 0), (3, 1, 3)], key=str)
    assert alignment.linked(docs.limit(0)).count() == 0
    assert alignment.linked(docs.filter("text is null")).select("n_a", "groups_sha256").collect() == [(0, "")]
