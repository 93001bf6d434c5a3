"""Substring dedup by difference-cover anchors.

A passage of WINDOW words that starts at word i of one document and at word j of another
has an aligned anchor: a run of ANCHOR words at i + d and j + d, both positions of which
fall in the cover modulo PERIOD. So anchors are hashed at 3 of 7 positions only, and
still every shared window holds a shared anchor. Shared anchors are then extended to the
windows around them, which are compared by an 80-bit hash (beside its key range) of all their words.

Both comparisons combine on the map side: within a chunk of documents a key that several
documents hold is settled for all but the smallest, and only that one goes on. A passage
that a third of all documents share therefore sends one entry a chunk, not one a document.
What goes on is packed: a row is one chunk's share of one key range, with sorted keys,
documents and positions as arrays, so a shuffled entry takes a dozen bytes or less.

Cases: null has no words; a document with fewer than WINDOW words loses nothing; exact
copies keep the smallest ``doc_id`` whole; ``doc_id`` names one text: rows that repeat it
with the same text are answered alike (with other texts, the windows of all are taken
together by position); rows with null ``doc_id`` lose nothing and give no windows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of input behind one key range at most; a task holds the keys of a range at a time.
RANGE_INPUT = 16 << 20
ROWS = "part int, payload binary, settled boolean"


def _document_rows(batch: pa.RecordBatch):
    """Chunks of a batch (doc_id, text, ...): ids, rows a..b, first word of each row, word hashes."""
    data, at = common.text_bytes(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for a, b in common.chunks(at):
        _, _, first, h = common.word_hashes(data, at[a : b + 1])
        yield ids[a:b].astype(np.int64), a, b, first, h


def grouped(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``order`` (by key, then document) and, in that order: a key's first row; the key is in
    several documents; a smaller document has the key."""
    order = np.lexsort((doc, *reversed(keys)))
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order[1:]] == k[order[:-1]]
    group = np.cumsum(~same) - 1
    d = doc[order]
    later = d > d[~same][group]
    several = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    several[group[later]] = True
    return order, ~same, several[group], later


def _packed(parts: np.ndarray, keys: tuple[np.ndarray, ...], doc: np.ndarray, pos: np.ndarray):
    """(part, payload) of rows sorted by part."""
    edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True]) if len(parts) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        table, index = np.unique(doc[a:b], return_inverse=True)
        index = index.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32)
        p = pos[a:b].astype(np.uint16 if pos[a:b].max() < 1 << 16 else np.uint32)
        head = np.array([b - a, len(table), index.itemsize, p.itemsize], np.int64)
        yield int(parts[a]), b"".join(x.tobytes() for x in (head, table, *(k[a:b] for k in keys), index, p))


def _unpacked(payloads: list[bytes], kinds: tuple[type, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    keys, docs, poss = [[] for _ in kinds], [], []
    for raw in payloads:
        n, tables, wide_index, wide_pos = np.frombuffer(raw, np.int64, 4).tolist()
        at = 32
        table = np.frombuffer(raw, np.int64, tables, at)
        at += 8 * tables
        for out, kind in zip(keys, kinds):
            out.append(np.frombuffer(raw, kind, n, at))
            at += n * out[-1].itemsize
        docs.append(table[np.frombuffer(raw, f"u{wide_index}", n, at)])
        at += n * wide_index
        poss.append(np.frombuffer(raw, f"u{wide_pos}", n, at).astype(np.int32))
    return tuple(map(np.concatenate, keys)), np.concatenate(docs), np.concatenate(poss)


def _rows(packed, settled: bool) -> pa.RecordBatch:
    rows = list(packed)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([settled] * len(rows), pa.bool_())], ["part", "payload", "settled"])


def _by_document(doc: np.ndarray, pos: np.ndarray, parts: int) -> pa.RecordBatch:
    """Settled entries, on the way to the part that gathers their documents."""
    part = (common.mix(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return _rows(_packed(part[order], (), doc[order], pos[order]), True)


def _part_by_part(batches):
    """Each part with its (payload, settled) pairs, of rows sorted by part."""
    now, held = None, []
    for batch in batches:
        for part, payload, settled in zip(*(c.to_pylist() for c in batch.columns)):
            if held and part != now:
                yield now, held
                held = []
            now = part
            held.append((payload, settled))
    if held:
        yield now, held


def _compared(rows: DataFrame, parts: int, kinds: tuple[type, ...], every: bool) -> DataFrame:
    """doc_id, pos (array<int>): settled entries, and those whose key several documents have
    (``every``) or a smaller one has. Keys meet in one shuffle, a document's entries in the next."""

    def compare(batches):
        for part, held in _part_by_part(batches):
            ready = [p for p, settled in held if settled]
            if ready:  # settled entries already know their part
                yield _rows([(part, p) for p in ready], True)
            if payloads := [p for p, settled in held if not settled]:
                keys, doc, pos = _unpacked(payloads, kinds)
                order, _, shared, later = grouped(keys, doc)
                take = order[shared if every else later]
                if len(take):
                    yield _by_document(doc[take], pos[take], parts)

    def gather(batches):
        for _, held in _part_by_part(batches):
            _, doc, pos = _unpacked([p for p, _ in held], ())
            order = np.argsort(doc, kind="stable")
            doc, pos = doc[order], pos[order]
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(pos))], ["doc_id", "pos"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(parts, F.col("part")).sortWithinPartitions("part")

    return dealt(dealt(rows).mapInArrow(compare, ROWS)).mapInArrow(gather, "doc_id long, pos array<int>")


def _parts(plain: DataFrame) -> int:
    """Key ranges: as many as the session shuffles into, but no more than RANGE_INPUT bytes of what ``plain`` reads in each."""
    size = int(plain._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    session = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return session if size >= 1 << 50 else max(session, size // RANGE_INPUT)


def shared_anchors(plain: DataFrame) -> DataFrame:
    """doc_id and pos (array<int>) of the anchors that more than one document has.

    32 bits of the hash are kept beside its key range. A chance match costs a comparison
    of windows and no more, as those are compared by 80 bits beside the range.
    """
    parts = _parts(plain)

    def run(batches):
        for batch in batches:
            for ids, _, _, first, h in _document_rows(batch):
                sizes = np.diff(first)
                key = common.runs(h, ANCHOR, 7)
                at = np.arange(len(h))
                pos = at - np.repeat(first[:-1], sizes)
                at = at[np.isin(pos % PERIOD, COVER) & (np.repeat(first[1:], sizes) - at >= ANCHOR)]
                if not len(at):
                    continue
                key, doc, pos = key[at], np.repeat(ids, sizes)[at], pos[at]
                part, key = (key >> np.uint64(32)) % np.uint64(parts), key.astype(np.uint32)
                order, first_row, shared, _ = grouped((part, key), doc)
                part, key, doc, pos = part[order], key[order], doc[order], pos[order]
                send = first_row | ~shared  # settled keys send one row, for the other chunks
                yield _rows(_packed(part[send].astype(np.int64), (key[send],), doc[send], pos[send]), False)
                if shared.any():
                    yield _by_document(doc[shared], pos[shared], parts)

    return _compared(plain.mapInArrow(run, ROWS), parts, (np.uint32,), True)


def repeated_windows(plain: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id and starts (array<int>): windows whose words also start in a smaller document."""
    parts = _parts(plain)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            edges = np.asarray(lists.offsets)
            values = lists.values.to_numpy(zero_copy_only=False)
            for ids, a, b, first, h in _document_rows(batch):
                high, low = common.runs(h, WINDOW, 11), common.runs(h, WINDOW, 13)
                counts = edges[a + 1 : b + 1] - edges[a:b]
                row = np.repeat(np.arange(b - a), counts)
                anchor = values[edges[a] : edges[b]].astype(np.int64) + first[:-1][row]
                wanted = np.zeros(len(h) + 1, bool)
                for back in range(PERIOD):  # the windows that hold the anchor
                    at = anchor - back
                    wanted[at[(at >= first[:-1][row]) & (at + WINDOW <= first[1:][row])]] = True
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                row = np.searchsorted(first, at, "right") - 1
                doc, start = ids[row], at - first[:-1][row]
                part = (low[at] >> np.uint64(32)) % np.uint64(parts)
                keys = (part, high[at], low[at].astype(np.uint16))
                order, _, _, later = grouped(keys, doc)
                part, doc, start = part[order], doc[order], start[order]
                send = ~later
                yield _rows(_packed(part[send].astype(np.int64), tuple(k[order][send] for k in keys[1:]), doc[send], start[send]), False)
                if later.any():
                    yield _by_document(doc[later], start[later], parts)

    rows = plain.join(anchors, "doc_id").select("doc_id", "text", "pos").mapInArrow(run, ROWS)
    return _compared(rows, parts, (np.uint64, np.uint16), False).withColumnRenamed("pos", "starts")


def _cut(batches):
    """doc_id, n_words, n_removed, kept of rows (doc_id, text, starts)."""
    for batch in batches:
        data, at = common.text_bytes(batch.column(1))
        lists = batch.column(2)
        lists = pc.fill_null(lists, []) if lists.null_count else lists
        edges, values = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
        for a, b in common.chunks(at):
            starts, ends, first = common.words(data, at[a : b + 1])
            sizes = np.diff(first)
            row = np.repeat(np.arange(b - a), edges[a + 1 : b + 1] - edges[a:b])
            begin = values[edges[a] : edges[b]].astype(np.int64) + first[:-1][row]
            begin = begin[begin + WINDOW <= first[1:][row]]
            cover = np.bincount(begin, minlength=len(starts) + 1)[: len(starts) + 1] - np.bincount(begin + WINDOW, minlength=len(starts) + 1)[: len(starts) + 1]
            keep = np.cumsum(cover)[:-1] == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[first]
            base = int(at[a])
            raw = data[base : int(at[b])].tobytes()
            s, e = (starts[keep] - base).tolist(), (ends[keep] - base).tolist()
            texts = [b" ".join([raw[x:y] for x, y in zip(s[p:q], e[p:q])]) for p, q in zip(kept[:-1].tolist(), kept[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(sizes - np.diff(kept)), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every row.

    Texts are shuffled once: both joins by ``doc_id`` read the same exchange.
    """
    common.arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = rows.filter("doc_id is not null and text is not null")
    anchors = common.materialise(shared_anchors(plain), "anchors")
    joined = plain.join(repeated_windows(plain, anchors), "doc_id", "left").select("doc_id", "text", "starts")
    others = rows.filter("doc_id is null or text is null").withColumn("starts", F.lit(None).cast("array<int>"))
    return joined.unionByName(others).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: the contract spelled out, every window by its words.
OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE d < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""
