import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packproof.llm import bpe

PATTERN = public_tokenizers.PATTERN
with open(bpe.DEFAULT_VOCABULARY, "rb") as lines:
    ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})


def ours(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, sizes, ends, counts = bpe.encode_chunk(data, offsets, bpe.pieces_of(bpe.DEFAULT_VOCABULARY))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])], [x.tolist() for x in np.split(ends, np.cumsum(counts)[:-1])]


CASES = ["", " ", "  ", "a", "it's we're 's ''s 'll 'x", " 's", "\n's", "a\n\n b  c\t\td \n", "x  ", "12ab 34,,'t", "é ñ ß 漢字 　x", "!'s?", "'re's'd'", "🙂🙂 '", " a", "a'sabc 'vex", "  's\x1c\x1d a", "<|endoftext|>", "abc" * 3000, "́a ​z"]


def test_cases():
    got, ends = ours(CASES)
    assert got == [ORACLE.encode_ordinary(t) for t in CASES]
    assert [e[-1] if e else 0 for e in ends] == [len(t.encode()) for t in CASES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 's\n\t'relvtmd1.,é"), st.characters(exclude_categories=("Cs",))), max_size=40), min_size=1, max_size=5))
def test_as_tiktoken(texts):
    assert ours(texts)[0] == [ORACLE.encode_ordinary(t) for t in texts]


def test_query(spark):
    rows = [(1, "It's a test"), (2, None), (3, ""), (1, "It's a test"), (None, "né " * 50), (5, "x" * 5000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(docs).collect()), key=str)
    want = []
    for i, t in rows:
        ids = ORACLE.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(regex.findall(PATTERN, t or ""))))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs.limit(0)).count() == 0


def test_offsets_are_held_against_ids(spark):
    docs = spark.createDataFrame([(1, "It's a test"), (2, "")], "doc_id long, text string")
    encoded = bpe.encode(docs)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(encoded).collect()} == {1: "It's a test", 2: ""}
    for wrong in ("transform(piece_ends, x -> x + 1)", "slice(piece_ends, 1, 2)", "array(1, 11)"):
        with pytest.raises(Exception, match="do not fit"):
            bpe.decode(encoded.withColumn("piece_ends", F.expr(f"if(doc_id = 1, {wrong}, piece_ends)"))).collect()
