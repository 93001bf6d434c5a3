"""Live frames, audit events and scans as streams (STR). Every function takes a stream or a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.records import FINE

#: Least focus of a usable frame; statutory categories that trigger a capture.
FOCUS, ENOUGH = 40.0, 2
#: Title and clause of a violation without a failed rule.
DEFECT, PROVISION = "Unknown Compliance Defect", "General Provision"


def gate_frames(frames: DataFrame) -> DataFrame:
    """STR-1: frames sharp enough, stateless."""
    return frames.filter(F.col("focus") > FOCUS).select("session", "frame_no", "ts", "focus", "categories")


def sample_frames(frames: DataFrame, every: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """STR-3: the sharpest frame of each session and window; frames later than the watermark are dropped in a stream."""
    marked = frames.withWatermark("ts", late) if frames.isStreaming else frames
    best = marked.groupBy("session", F.window("ts", every)).agg(F.max_by(F.struct("frame_no", "focus"), F.struct("focus", "frame_no")).alias("f"))
    return best.select("session", F.col("window.start").alias("start"), "f.*")


class FirstCapture(StatefulProcessor):
    """One session: the earliest good frame, given out once the watermark has passed it; nothing more until the session was idle.

    ``first`` holds the frame's time in microseconds, its number and whether it was given out,
    ``until`` the end of the session so far in milliseconds. Timers: the frame's own time, then
    the end of the session.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long, frame_no long, given boolean")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        seen = [(r["at"], r["frame_no"]) for r in rows]
        seen = [x for x in seen if x[0] >= now * 1000]  # later ones are late
        if not seen:
            return
        best = min(seen)
        if not self.first.exists():
            self._hold(best)
        else:
            at, number, given = self.first.get()
            if not given and best < (at, number):
                self.handle.deleteTimer(at // 1000 + 1)
                self._hold(best)
        end = max(seen)[0] // 1000 + self.idle
        if self.until.exists():
            end = max(end, self.until.get()[0])
        self.until.update((end,))
        return
        yield  # a generator without rows: frames are given out by timers

    def _hold(self, frame: tuple[int, int]) -> None:
        self.first.update((*frame, False))
        self.handle.registerTimer(frame[0] // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.first.exists():
            return
        at, number, given = self.first.get()
        if not given:
            self.first.update((at, number, True))
            yield Row(session=key[0], frame_no=number, at=at)
        end = self.until.get()[0]
        if expiredTimerInfo.getExpiryTimeInMs() >= end:
            self.first.clear()
            self.until.clear()
        else:
            self.handle.registerTimer(end)


def auto_capture(frames: DataFrame, idle: str = "30 minutes", late: str = "10 seconds") -> DataFrame:
    """STR-2: the first sharp frame of each session with enough categories.

    A batch takes the minimum by time. A stream gives a frame out when the watermark has passed
    it, so frames that come out of order by up to ``late`` change nothing; frames behind the
    watermark are dropped. A session that has been idle for ``idle`` past the watermark leaves
    the state; its next frame begins a new one. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), set here on the session.
    """
    good = frames.filter((F.col("focus") > FOCUS) & (F.col("categories") >= ENOUGH))
    if not frames.isStreaming:
        return good.groupBy("session").agg(F.min_by(F.struct("frame_no", "ts"), F.struct("ts", "frame_no")).alias("f")).select("session", "f.*")
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = good.withWatermark("ts", late).select("session", "frame_no", "ts", F.unix_micros("ts").alias("at")).groupBy("session")
    held = keyed.transformWithState(FirstCapture(int(pd.Timedelta(idle).total_seconds() * 1000)), "session string, frame_no long, at long", "append", "EventTime")
    return held.select("session", "frame_no", F.timestamp_micros("at").alias("ts"))


def stream_violations(scans: DataFrame, first_failures: DataFrame) -> DataFrame:
    """STR-4: violations of scans as they arrive. ``first_failures``: scan_id, title, clause (a static table).

    Columns scan_id, product_name, title, clause, fine and day: the day of ``ts`` or ``scan_date``, whichever scans have.
    """
    bad = scans.filter(F.col("verdict") == "NON-COMPLIANT")
    joined = bad.join(first_failures.withColumnRenamed("scan_id", "id"), "id", "left")
    day = F.substring(F.col("ts" if "ts" in scans.columns else "scan_date").cast("string"), 1, 10)
    fine = F.coalesce(F.nullif(F.col("penalty").cast("long"), F.lit(0)), F.lit(FINE)).cast("long")
    return joined.select(F.col("id").alias("scan_id"), "product_name", F.coalesce("title", F.lit(DEFECT)).alias("title"), F.coalesce("clause", F.lit(PROVISION)).alias("clause"), fine.alias("fine"), day.alias("day"))


def merge_batch(violations: DataFrame, batch: int, path: str) -> None:
    """Write one batch's violations, one row a scan, into its own partitions ``day`` and ``batch`` of the table at ``path``.

    Partitions of the same batch are overwritten and no others are touched, so a batch that is
    played again, whole or in part written before, leaves the same table.
    """
    fields = [c for c in violations.columns if c != "scan_id"]
    own = violations.groupBy("scan_id").agg(F.max(F.struct(*fields)).alias("v")).select("scan_id", "v.*", F.lit(batch).cast("long").alias("batch"))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def merge_violations(violations: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the stream ``violations`` (as ``stream_violations`` makes it) that keeps each scan's violation exactly once."""
    return violations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: merge_batch(rows, batch, path))


def read_violations(spark: SparkSession, path: str) -> DataFrame:
    """The merged table: one row a scan, of the last batch that had it. A filter on ``day`` reads that day's partitions.

    A scan that comes again under another day counts for both days.
    """
    rows = spark.read.schema("scan_id string, product_name string, title string, clause string, fine long, day string, batch long").parquet(path)
    return rows.groupBy("day", "scan_id").agg(F.max_by(F.struct("product_name", "title", "clause", "fine"), "batch").alias("v")).select("scan_id", "v.*", "day")


def stream_kpis(scans: DataFrame, late: str = "1 day") -> DataFrame:
    """STR-4: scans and compliant scans per day. Columns ts, verdict."""
    marked = scans.withWatermark("ts", late) if scans.isStreaming else scans
    daily = marked.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "COMPLIANT", 1)).alias("compliant"))
    return daily.select(F.col("window.start").alias("day"), "n", "compliant")


def append_audit(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """STR-5: each event id once. Columns id, ts and others."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return events.dropDuplicates(["id"])
