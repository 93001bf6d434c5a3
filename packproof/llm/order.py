"""Training-order materialisation of token sequences.

Documents become sequences of LENGTH token ids: each document's ids and one end mark, cut
into pieces of LENGTH, the last filled up with end marks. A sequence's number comes from its
document's identity: (doc_id - smallest doc_id) * S + place in the document, where S is the
most sequences that any text can have, as no token is shorter than a byte. So neither a
count of tokens nor an order of rows is needed first, and other partitions of the same rows
give the same numbers. A keyed Feistel permutation over the next power of two, walked until
it falls below the number of such places, gives the sequence's global slot.

Slots are dealt to shard files by ranges of equal width, as many as hold PER_SHARD sequences
at most if every token were one byte; a task writes several consecutive shards. Within a
shard sequences stand in the order of their slots, all with the same stride; slots of places
that no sequence has leave no gap. Reading in order is reading shards in order, and may
resume at any sequence, as a shard's size tells how many it holds.

Tasks send a range's sequences in packed, compressed rows without the fill; the writer of
a shard fills them up. A shard's bytes depend on its slots only. It is written beside its
place and moved there when complete, so a repeated task replaces it by the same bytes.

Cases: null reads as empty; an empty text is one sequence that holds only the end mark;
rows that repeat a doc_id have sequences of their own in the same slots, ordered by their
content; rows without doc_id are numbered after the others by a hash of their text and its
occurrence in the task; ids so far apart that numbers would pass 2**62 are hashed first, and
slots shared by chance are ordered by doc_id; extra columns are ignored; an empty table gives
no shards. Ids take two bytes, or four where the vocabulary is larger than that.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common
from .media import _file, _uri

LENGTH, PER_SHARD = 256, 1 << 16
ROUNDS = 4
#: Ids that a task holds before it sends them, packed by shard.
HELD = 1 << 24
#: Numbers stay below this.
MOST = 1 << 62
INDEX = "slot long, doc_id long, seq_no int, n_tokens int, shard int, offset long, crc32 long"


def permuted(number: np.ndarray, n: int, key: str) -> np.ndarray:
    """Slots of sequence numbers: a bijection of 0..n-1 that ``key`` chooses."""
    bits = max(2, int(n - 1).bit_length())
    low_bits = bits // 2
    keys = np.frombuffer(hashlib.sha256(key.encode()).digest(), np.uint64)[:ROUNDS]
    out = number.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        wide, narrow = bits - low_bits, low_bits
        for k in keys:  # halves of either width take turns; an even number of rounds puts them back
            left, right = x >> np.uint64(narrow), x & np.uint64((1 << narrow) - 1)
            left ^= common.mix(right + k) & np.uint64((1 << wide) - 1)
            x = (right << np.uint64(wide)) | left
            wide, narrow = narrow, wide
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """What numbers, slots and shards depend on: bounds of ids and text lengths, never single rows."""

    low: int
    ids: int
    nulls: int
    per_doc: int
    shards: int
    length: int
    wide: int
    end: int

    @property
    def places(self) -> int:
        return (self.ids + self.nulls) * self.per_doc

    @property
    def kind(self) -> str:
        return f"<u{self.wide}"

    def numbers(self, doc_id: np.ndarray, known: np.ndarray, unknown: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Numbers of sequences of rows with ``doc_id`` where ``known``, else with the hash ``unknown``."""
        own = doc_id.astype(np.uint64) - np.uint64(self.low & (1 << 64) - 1)
        if self.ids * self.per_doc >= MOST // 2:
            own = common.mix(own) % np.uint64(self.ids)
        own = np.where(known, own, np.uint64(self.ids) + unknown % np.uint64(max(self.nulls, 1)))
        return own * np.uint64(self.per_doc) + seq.astype(np.uint64)


def layout(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> Layout:
    """One scan of ids and text lengths."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    doc_id = F.col("doc_id").cast("long")
    low, high, rows, known, longest, most = docs.agg(F.min(doc_id), F.max(doc_id), F.count("*"), F.count(doc_id), F.max(size), F.sum(F.floor(size / length) + 1)).first()
    per_doc = (longest or 0) // length + 1
    ids = high - low + 1 if known else 0
    nulls = rows - known
    if ids * per_doc >= MOST // 2:
        ids = MOST // 2 // per_doc
    end = max(bpe.load_ranks(vocabulary).values()) + 1
    return Layout(low or 0, ids, nulls, per_doc, max(1, -(-(most or 0) // per_shard)), length, 2 if end < 1 << 16 else 4, end)


def _packed(plan: Layout, shard: np.ndarray, fields: list[np.ndarray], used: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """(shard, payload) rows of sequences whose ids stand one after another."""
    order = np.argsort(shard, kind="stable")
    first = np.cumsum(used) - used
    shard, used, first = shard[order], used[order], first[order]
    fields = [f[order] for f in fields]
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(1, np.int64)
    codec, out = pa.Codec("zstd", compression_level=3), []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        n = used[a:b]
        own = ids[np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        planes = own.astype(plan.kind).view(np.uint8).reshape(-1, plan.wide).T
        raw = b"".join([np.array([b - a, len(own)], "<i8").tobytes(), *(f[a:b].tobytes() for f in fields), n.astype("<i4").tobytes(), planes.tobytes()])
        out.append(len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]], pa.int32()), pa.array(out, pa.binary())], ["shard", "payload"])


def _unpacked(plan: Layout, payloads: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """slot, doc_id, known and seq_no of all sequences; used; records filled to the full length."""
    codec, parts, bodies = pa.Codec("zstd"), [], []
    for payload in payloads:
        raw = codec.decompress(payload[8:], int.from_bytes(payload[:8], "little"), asbytes=True)
        n, total = np.frombuffer(raw, "<i8", 2).tolist()
        at, own = 16, []
        for kind in ("<i8", "<i8", "?", "<i4", "<i4"):
            own.append(np.frombuffer(raw, kind, n, at))
            at += n * own[-1].itemsize
        parts.append(own)
        bodies.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, total * plan.wide, at).reshape(plan.wide, -1).T).view(plan.kind).ravel())
    *fields, used = map(np.concatenate, zip(*parts))
    records = np.full((len(used), plan.length), plan.end, plan.kind)
    records[np.arange(plan.length) < used[:, None]] = np.concatenate(bodies)
    return fields, used, records


def sequences(docs: DataFrame, plan: Layout, key: str, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """shard and payload: the sequences of ``docs``, packed by shard."""
    common.arrow_batches(docs.sparkSession)
    length = plan.length

    def run(batches):
        pieces, met = bpe.pieces_of(vocabulary), Counter()
        held, size = [], 0

        def flush():
            doc_id, known, unknown, seq, used, ids = (np.concatenate(x) for x in zip(*held))
            slot = permuted(plan.numbers(doc_id, known, unknown, seq), plan.places, key)
            return _packed(plan, slot // -(-plan.places // plan.shards), [slot, doc_id, known, seq], used, ids)

        for batch in batches:
            data, at = common.text_bytes(batch.column(1))
            column = batch.column(0)
            every, there = column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            hashes = batch.column(2).to_numpy().copy().view(np.uint64)
            for k in np.flatnonzero(~there).tolist():
                h = int(hashes[k])
                hashes[k] = (h + met[h] * 0x9E3779B97F4A7C15) & (1 << 64) - 1
                met[h] += 1
            for a, b in common.chunks(at):
                ids, sizes, _, _ = bpe.encode_chunk(data, at[a : b + 1], pieces)
                flat = np.insert(ids, np.cumsum(sizes), plan.end)  # the end mark of each text
                counts = sizes // length + 1
                row = np.repeat(np.arange(a, b), counts)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                used = np.minimum(np.repeat(sizes, counts) + 1 - seq * length, length)
                held.append((every[row], there[row], common.mix(hashes[row]), seq.astype(np.int32), used, flat))
                size += len(flat)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(run, "shard int, payload binary")


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialise(docs: DataFrame, folder: str, key: str = "epoch-0", length: int = LENGTH, per_shard: int = PER_SHARD, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """Write shards to ``folder``; the index: slot, doc_id, seq_no, n_tokens, shard, offset, crc32."""
    spark = docs.sparkSession
    plan = layout(docs, length, per_shard, vocabulary)
    tasks = min(plan.shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = _uri(folder)

    def written(shard: int, payloads: list[bytes]) -> pa.RecordBatch:
        system, place = _file(folder)
        (slot, doc_id, known, seq), used, records = _unpacked(plan, payloads)
        crc = np.array([zlib.crc32(r) for r in records], np.int64)
        order = np.lexsort((crc, seq, doc_id, slot))
        system.create_dir(place, recursive=True)
        name = f"{place}/.writing-{uuid.uuid4().hex}"
        try:
            with system.open_output_stream(name) as out:
                out.write(records[order].tobytes())
            system.move(name, f"{place}/{_name(shard)}")
        except BaseException:
            with contextlib.suppress(OSError):
                system.delete_file(name)
            raise
        n = len(order)
        columns = [pa.array(slot[order]), pa.array(doc_id[order], mask=~known[order]), pa.array(seq[order]), pa.array(used[order]), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n) * (plan.wide * length)), pa.array(crc[order])]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])

    def write(batches):
        now, held = None, []
        for batch in batches:
            for shard, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held and shard != now:
                    yield written(now, held)
                    held = []
                now = shard
                held.append(payload)
        if held:
            yield written(now, held)

    rows = sequences(docs, plan, key, vocabulary).withColumn("task", F.expr(f"cast(shard * {tasks}L div {plan.shards} as int)"))
    dealt = rows.select("task", "shard", "payload").repartitionById(tasks, F.col("task")).sortWithinPartitions("shard")
    index = common.materialise(dealt.mapInArrow(write, INDEX), "slots")
    _sweep(folder)
    return index


def _sweep(folder: str) -> None:
    """Delete what tasks that died have left; all shards are complete by now."""
    system, place = _file(folder)
    for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        if info.base_name.startswith(".writing-"):
            system.delete_file(info.path)


def read(folder: str, start: int, count: int, length: int = LENGTH, wide: int = 2):
    """``count`` sequences from the ``start``-th on, in training order: how a trainer resumes."""
    system, place = _file(_uri(folder))
    stride = wide * length
    for info in sorted(system.get_file_info(fs.FileSelector(place)), key=lambda i: i.base_name):
        if not info.base_name.startswith("shard-"):
            continue
        here = info.size // stride
        if start < here and count > 0:
            n = min(count, here - start)
            with system.open_input_file(info.path) as f:
                raw = f.read_at(n * stride, start * stride)
            yield from np.frombuffer(raw, f"<u{wide}").reshape(-1, length)
            start, count = start + n, count - n
        start = max(0, start - here)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(common.table(spark, sf_dir, "documents"), common.shared_path(spark, "shards"))
