"""Shared helpers: the cluster's shared folder, text as flat byte arrays, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21
#: Rows and bytes of one Arrow batch between the JVM and a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20

_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 64, 1 << 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``; only a local master may go without
    one, and a temporary folder becomes the session's checkpoint folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession) -> None:
    """Keep batches between JVM and Python small, so that long texts fit beside each other."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (a, b) that hold at most ``limit`` bytes, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without space, tab, newline, VT, FF, CR) of consecutive texts.

    ``offsets`` are byte offsets of the texts in ``data``. Returns start and end byte of
    every word, and for each text the index of its first word (one more at the end).
    """
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets - base] = True
    edge[0] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts + base, ends + base, np.searchsorted(starts, offsets - base)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``words`` and a 64-bit multilinear hash of each word's bytes."""
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return starts, ends, first, np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    part = data[lo:hi]
    place = np.arange(hi - lo, dtype=np.int64)
    origin = np.zeros(hi - lo, np.int64)
    origin[starts - lo] = starts - lo
    place -= np.maximum.accumulate(origin)
    longest = int((ends - starts).max())
    weight = _PLACE[place & 0xFFFF]
    if longest > 1 << 16:
        weight = weight + (place >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C14)
    value = np.add.reduceat(_BYTE[part] * weight, starts - lo)
    return starts, ends, first, mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(h: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive word hashes (texts are not told apart)."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    m = len(h) - length + 1
    factor = np.random.default_rng(seed).integers(0, 1 << 64, length, dtype=np.uint64) | np.uint64(1)
    out = np.zeros(m, np.uint64)
    for k in range(length):
        out += h[k : k + m] * factor[k]
    return mix(out)
