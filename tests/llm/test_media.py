import hashlib
import zlib

from packproof.llm import common, media

ROWS = [(1, "abc"), (2, None), (3, ""), (4, "é" * 288), (5, "é" * 289), (5, "é" * 289), (None, "x" * 200_000), (7, "abc")]


def frame(spark):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in ROWS], "doc_id long, text string, shard string, digest int").repartition(3)


def test_brute(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, media.op4(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in ROWS:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        image = media.to_png(raw)
        counts = [sum(1 for x in payload if x >> 4 == k) for k in range(16)]
        rows = len(payload) // 576
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), f"{rows}:" + ",".join(map(str, counts)), 576, rows, 8))
    assert got == sorted(want, key=str)
    frame(spark).limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert media.op4(spark, str(tmp_path)).count() == 0


def test_shards_are_tar_files(spark):
    folder = common.shared_path(spark, "media")
    manifest = media.store(frame(spark), folder)
    rows = manifest.collect()
    members = {s: media.unpack(folder, s) for s in {r["shard"] for r in rows}}
    for r in rows:
        image = members[r["shard"]][f"{bytes(r['digest']).hex()}.png"]
        assert len(image) == r["length"] and hashlib.sha256(image).digest() == bytes(r["digest"])
    heads = media.metadata(media.places(manifest), folder).collect()
    assert len(heads) == len({t or "" for _, t in ROWS}) and all(h["width"] == 576 and h["bits"] == 8 for h in heads)
