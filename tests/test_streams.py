import datetime
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from packproof.streaming import frames

START = datetime.datetime(2024, 1, 1)
SCAN = "id string, ts timestamp, product_name string, verdict string, penalty int"


def scans(k):
    """File k of five: four scans, one of which came before."""
    rows = [(f"INS-{n}", START + datetime.timedelta(hours=7 * n), f"Oil {n}", "NON-COMPLIANT" if n % 3 else "COMPLIANT", 0 if n % 2 else 5000) for n in range(4 * k, 4 * k + 4)]
    return rows + ([(rows[0][0].replace(str(4 * k), str(4 * k - 3)), START + datetime.timedelta(hours=7 * (4 * k - 3)), "Oil again", "NON-COMPLIANT", 100)] if k else [])


@pytest.mark.parametrize("stopped", ["before", "after", None])
def test_violations_merge_exactly_once(spark, tmp_path, stopped):
    """The third batch fails once, before or after its write but before the commit; the stream starts again from its checkpoint."""
    for k in range(5):
        spark.createDataFrame(scans(k), SCAN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    first = spark.createDataFrame([("INS-1", "No price", "6(1)"), ("INS-2", "No date", "6(2)")], "scan_id string, title string, clause string")
    path, failed = str(tmp_path / "out"), []
    stream = frames.stream_violations(spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), first)

    def start():
        writer = frames.merge_violations(stream, path, str(tmp_path / "check"))

        def merge(rows, batch):
            fail = stopped and batch == 2 and not failed
            if fail:
                failed.append(batch)
            if not fail or stopped == "after":
                frames.merge_batch(rows, batch, path)
            if fail:
                raise RuntimeError("lost")

        writer.foreachBatch(merge).trigger(availableNow=True).start().awaitTermination(180)

    if stopped:
        with pytest.raises(StreamingQueryException):
            start()
    start()
    got = {r["scan_id"]: r for r in frames.read_violations(spark, path).collect()}
    every = [r for k in range(5) for r in scans(k) if r[3] == "NON-COMPLIANT"]
    assert frames.read_violations(spark, path).count() == len(got) == len({r[0] for r in every})
    for scan, ts, product, _, penalty in every:
        if product == "Oil again" or scan not in {r[0] for r in every if r[2] == "Oil again"}:
            assert (got[scan]["product_name"], got[scan]["fine"], got[scan]["day"]) == (product, penalty or 25000, str(ts)[:10])
    assert got["INS-2"]["title"] == "No date" and got["INS-4"]["clause"] == "General Provision"
    # playing all batches again by another stream of the same batches changes nothing
    for batch in range(2):
        frames.merge_batch(frames.stream_violations(spark.createDataFrame(scans(4), SCAN), first), 4, path)
    assert sorted(map(tuple, frames.read_violations(spark, path).collect())) == sorted(map(tuple, got.values()))
    day = got["INS-2"]["day"]
    assert {r["scan_id"] for r in frames.read_violations(spark, path).filter(F.col("day") == day).collect()} == {s for s, r in got.items() if r["day"] == day}


FRAME = "session string, frame_no long, ts timestamp, focus double, categories int"


def capture(spark, folder, files, idle, late, name):
    """Frames of a stream, one file a batch, and the rows of its state after each batch."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out, states = [], []
    for _ in range(2):  # the second run starts from the first one's state and finds nothing new
        query = frames.auto_capture(stream, idle, late).writeStream.foreachBatch(lambda rows, batch: out.extend(map(tuple, rows.collect()))).option("checkpointLocation", str(folder / name)).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        states += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted(out), states


def test_capture_out_of_order(spark, tmp_path):
    """Shuffled within the watermark's delay: the stream equals the batch; the last session closes the others."""
    draw = random.Random(5)
    rows = [(f"s{draw.randint(0, 9)}", k, START + datetime.timedelta(seconds=k), 30.0 + draw.random() * 40, draw.randint(0, 4)) for k in range(240)]
    files = [rows[k : k + 60] for k in range(0, 240, 60)]
    for file in files:
        draw.shuffle(file)
    files = [files[1], files[0], files[3], files[2]]
    end = [("end", 9000, START + datetime.timedelta(days=2), 90.0, 4)]
    got, _ = capture(spark, tmp_path, [*files, end, [("end", 9001, START + datetime.timedelta(days=2, hours=1), 90.0, 4)]], "1 day", "10 minutes", "a")
    batch = spark.createDataFrame([r for f in files for r in f] + end, FRAME)
    assert got == sorted(map(tuple, frames.auto_capture(batch).collect()))


def test_capture_state_stays_small(spark, tmp_path):
    """Sessions of one minute each, one after the other: idle ones leave the state; a session that comes back is captured again; late frames are not."""
    minute = lambda k: START + datetime.timedelta(minutes=k)
    files = [[(f"s{k}", 10 * k + n, minute(10 * k) + datetime.timedelta(seconds=n), 80.0, 3) for n in range(5)] for k in range(8)]
    files.append([("s0", 500, minute(90), 80.0, 3), ("s1", 501, minute(0), 80.0, 3)])  # s1 is late by then
    files.append([("end", 900, minute(200), 80.0, 3)])
    files.append([("end", 901, minute(201), 80.0, 3)])
    got, states = capture(spark, tmp_path, files, "5 minutes", "10 seconds", "b")
    assert [(s, n) for s, n, _ in got] == sorted([(f"s{k}", 10 * k) for k in range(8)] + [("s0", 500), ("end", 900)])
    assert states and states[-1] <= 12  # a session has a few rows: two values and timers
