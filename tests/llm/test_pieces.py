import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packproof.llm import pieces

ORACLE = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
CASES = ["", " ", "  ", "▁", "a", "Hello  world\n é 一\U0001F600 <s> </s> <0x41> ▁x", " " * 37, "  x   y    z" + " " * 50 + "q", "a" * 5000, "\x00a\x00", "日本語" * 100, "x" * 47 + " " + "y" * 48, "éñ漢字" * 400]


def ours(texts):
    ids, sizes = pieces.encode_texts(texts, pieces.words_of(pieces.DEFAULT_MODEL))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_cases():
    assert ours([*CASES, None]) == [*ORACLE.encode(CASES), []]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abehinrst ▁\n1.,é"), st.characters(exclude_categories=("Cs",))), max_size=60), min_size=1, max_size=5))
def test_as_the_library(texts):
    assert ours(texts) == ORACLE.encode(texts)


def test_joined_pieces_and_long_words():
    draw = random.Random(7)
    spelt = [ORACLE.id_to_piece(k) for k in range(259, 32000)]
    texts = ["".join(draw.choice(spelt) for _ in range(draw.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(draw.choice(spelt) for _ in range(600)).replace("▁", "") for _ in range(5)]
    assert ours(texts) == ORACLE.encode(texts)


def test_fits_are_merges():
    """A fit says that two pieces, merged again, come apart where they were joined; both ways of finding out agree."""
    model = pieces.words_of(pieces.DEFAULT_MODEL).model
    draw = np.random.default_rng(3)
    a, b = draw.integers(259, 32000, 2000), draw.integers(259, 32000, 2000)
    together = model.fits(a, b)
    assert together.tolist() == [model._comes_apart(int(x), int(y)) for x, y in zip(a, b)]
    assert 0 < together.sum() < len(a)


def test_longest_matches():
    model = pieces.words_of(pieces.DEFAULT_MODEL).model
    text = "▁the▁quick漢brown▁▁▁fox\U0001F600" * 20
    want = [max((k for k in range(1, 17) if text[p : p + k] in model.piece and p + k <= len(text)), default=0) for p in range(len(text))]
    got = model.matches(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64))
    assert [int(model.length[k]) if k >= 0 else 0 for k in got] == want


def test_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_SIZE", 3)
    words = pieces.Words(pieces.words_of(pieces.DEFAULT_MODEL).model)
    for texts in (["a b c d e"], ["e d f g"], ["a"], ["h i j k l m"]):
        ids, _ = pieces.encode_texts(texts, words)
        assert ids.tolist() == ORACLE.encode(texts[0])


def test_query(spark):
    rows = [(1, "It's a test"), (2, None), (3, ""), (1, "It's a test"), (None, "né " * 50), (5, "x" * 5000), (6, "one▁two"), (7, "many words " * 3000)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, ids string, decoded string")
    want = []
    for i, t in rows:
        ids = ORACLE.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(ORACLE.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.digests(docs).collect()), key=str) == sorted(want, key=str)
    assert pieces.digests(docs.limit(0)).count() == 0


def test_decoding_any_ids(spark):
    """Ids that no text has: stray bytes, spaces in front, controls."""
    draw = random.Random(11)
    rows = [[draw.randint(3, 258) for _ in range(draw.randint(0, 8))] + [draw.randint(259, 31999) for _ in range(draw.randint(0, 4))] for _ in range(200)]
    rows += [[259], [259, 259], [13], [229, 259], [], [28705], [28705, 28705, 100], [0], [100, 0, 100]]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)] + [(-1, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in pieces.decode(frame).collect()}
    assert got.pop(-1) == ""
    assert got == {k: ORACLE.decode(r) for k, r in enumerate(rows)}
    with pytest.raises(Exception, match="not in the model"):
        pieces.decode(frame.withColumn("ids", F.array(F.lit(32000)))).collect()
