import base64
import os
import zlib

import numpy as np
import public_tokenizers
import tiktoken

from packproof.llm import bpe, common, order

with open(bpe.DEFAULT_VOCABULARY, "rb") as lines:
    ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        for key in ("a", "b"):
            assert sorted(order.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert order.permuted(np.arange(1000), 1000, "a").tolist() != order.permuted(np.arange(1000), 1000, "b").tolist()


def brute_sequences(rows, length, end=50256):
    out = []
    for i, t in rows:
        ids = [*ORACLE.encode_ordinary(t or ""), end]
        out += [(i, k // length, ids[k : k + length]) for k in range(0, len(ids), length)]
    return out


ROWS = [(k, f"text {k} " * (k * 3 % 50)) for k in range(60)] + [(100, None), (101, ""), (3, "again"), (3, "again"), (None, "no id"), (None, "no id"), (7**20, "far"), (-9, "long " * 3000)]


def frame(spark, rows, parts):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, slot int").repartition(parts)


def test_round_trip(spark):
    folder = common.shared_path(spark, "shards")
    index = sorted(order.materialise(frame(spark, ROWS, 3), folder, length=16, per_shard=100).collect(), key=lambda r: (r["shard"], r["offset"]))
    n = len(index)
    found = list(order.read(folder, 0, n + 5, 16))
    resumed = list(order.read(folder, 7, 200, 16))
    assert len(found) == n and all((a == b).all() for a, b in zip(found[7:207], resumed)) and len(resumed) == 200
    assert [r["slot"] for r in index] == sorted(r["slot"] for r in index) and max(r["shard"] for r in index) > 3
    got = []
    for r, ids in zip(index, found):
        assert zlib.crc32(ids.tobytes()) == r["crc32"] and all(x == 50256 for x in ids[r["n_tokens"] :])
        got.append((r["doc_id"], r["seq_no"], ids[: r["n_tokens"]].tolist()))
    assert sorted(got, key=str) == sorted(brute_sequences(ROWS, 16), key=str)


def test_slots_do_not_depend_on_partitions(spark):
    made = []
    rows = ROWS[:62] + ROWS[67:]  # rows with an id of their own
    for parts, shuffled in ((1, 2), (5, 4)):
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffled))
        folder = common.shared_path(spark, "shards")
        index = order.materialise(frame(spark, rows, parts), folder, length=16, per_shard=100).collect()
        made.append((sorted((r["doc_id"], r["seq_no"], r["slot"]) for r in index), [x.tolist() for x in order.read(folder, 0, len(index), 16)]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made[0] == made[1]
    slots = [x[2] for x in made[0][0]]
    assert len(set(slots)) == len(slots) and slots != sorted(slots)


def test_large_vocabularies_take_four_bytes(spark, tmp_path):
    path = f"{tmp_path}/wide.tiktoken"
    with open(path, "wb") as f:
        for k in range(256):
            f.write(base64.b64encode(bytes([k])) + b" %d\n" % (k + 70_000))
    folder = common.shared_path(spark, "shards")
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert order.materialise(docs, folder, length=4, vocabulary=path).count() == 1
    assert [x.tolist() for x in order.read(folder, 0, 1, 4, 4)] == [[70_097, 70_098, 70_256, 70_256]]


def test_failed_writers_leave_nothing(spark):
    folder = common.shared_path(spark, "shards")
    order.materialise(frame(spark, ROWS[:5], 2), folder)
    place = folder.removeprefix("file:")
    open(f"{place}/.writing-dead", "w").close()
    order.materialise(frame(spark, ROWS[:5], 2), folder)
    assert not [x for x in os.listdir(place) if x.startswith(".writing")]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert order.materialise(docs, common.shared_path(spark, "shards")).count() == 0
