"""Alignment of two tokenisations of the same bytes, and corpus-wide links between their ids.

Tokenizer A is byte-level BPE over space + text, tokenizer B a merge-type piece model, which
puts that space itself. Offsets where a token of both ends are found by a galloping
intersection: the shorter list of ends drives, and each of its ends is looked for in the
longer one from where the last was found, by doubling steps and then a binary search. Slices
of the driving list gallop side by side, one array operation a step. The common ends cut
both lists into groups; differences of their ranks say how many tokens of A and of B share
a group, and every token of A links to every token of B there.

The corpus-wide count of a pair of ids (documents that hold it linked) is exact. A task cuts
its documents into shares and counts a share's pairs once; shares' counts are summed by pair
(every share has a pair once, so no pair is a hot key), the highest count of each A id is one
row of the vocabulary and is broadcast, and the counts return to the shares that asked, each
as one group of bounded size. Texts are encoded once, into a table in the shared folder.

Cases: a text that is null or empty, or whose pieces do not spell it (U+2581 is a space to
B), has no tokens, only zeros and ''. Repeated rows are documents of their own; null ids
stay; columns of ``docs`` other than those in ``keep`` are ignored. A group of many tokens
is counted by distinct ids, not by pairs of places. Memory follows the share, or the longest text.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common, pieces

DEFAULT_A = public_tokenizers.path("byte_bpe_50k.json")
DEFAULT_B = pieces.DEFAULT_MODEL
#: Bytes of text whose pairs are counted together.
SHARE_BYTES = 8 << 20
#: Needles that one lane of the galloping search works through.
LANE = 64
#: Groups with more links than this are counted by distinct ids.
WIDE = 1024

DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


@functools.cache
def _byte_of() -> dict[str, int]:
    """Bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def side_a(path: str) -> tuple[bpe.Pieces, np.ndarray]:
    """Encoder and byte length of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ranks = {bytes(map(_byte_of().__getitem__, entry)): k for entry, k in vocabulary.items()}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for entry, k in ranks.items():
        sizes[k] = len(entry)
    return bpe.Pieces(ranks), sizes


@functools.cache
def _numerals(n_a: int, n_b: int) -> pa.Array:
    """Decimal ids with what follows them: A's with , or |, then B's with , or ;."""
    return pa.array([f"{k}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for k in range(n) for end in ends], pa.large_string())


def _advance(hay: np.ndarray, at: np.ndarray, needle: np.ndarray) -> np.ndarray:
    """First place from ``at`` on whose end is not below ``needle``: doubling steps, then a binary search."""
    last = len(hay) - 1
    low, high, step = at.copy(), at.copy(), 1
    todo = np.flatnonzero(hay[high] < needle)
    while len(todo):
        low[todo] = high[todo] + 1
        high[todo] = np.minimum(high[todo] + step, last)
        step *= 2
        todo = todo[hay[high[todo]] < needle[todo]]
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) >> 1
        less = hay[middle] < needle[todo]
        low[todo] = np.where(less, middle + 1, low[todo])
        high[todo] = np.where(less, high[todo], middle)
        todo = todo[low[todo] < high[todo]]
    return low


def gallop(needles: np.ndarray, hay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of common values in two rising lists of which ``needles`` is the shorter and has no value above the other's last."""
    n = len(needles)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes = -(-n // LANE)
    grid = np.concatenate([needles, np.full(lanes * LANE - n, needles[-1])]).reshape(lanes, LANE)
    found = np.empty((LANE, lanes), np.int64)
    at = np.zeros(lanes, np.int64)
    for k in range(LANE):
        at = found[k] = _advance(hay, at, np.ascontiguousarray(grid[:, k]))
    at = found.T.ravel()[:n]
    common_ = np.flatnonzero(hay[at] == needles)
    return common_, at[common_]


def common_ends(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of common ends in both lists; in each text the shorter list drives."""
    a_drives = a_sizes <= b_sizes
    found = []
    for drives, needles, sizes, hay, hay_sizes in ((a_drives, a, a_sizes, b, b_sizes), (~a_drives, b, b_sizes, a, a_sizes)):
        own, other = np.flatnonzero(np.repeat(drives, sizes)), np.flatnonzero(np.repeat(drives, hay_sizes))
        x, y = gallop(needles[own], hay[other])
        found.append((own[x], other[y]))
    x = np.concatenate([found[0][0], found[1][1]])
    order = np.argsort(x, kind="stable")
    return x[order], np.concatenate([found[0][1], found[1][0]])[order]


class Aligned:
    """Both tokenisations of consecutive texts, cut into groups; texts are numbered from 0."""

    def __init__(self, texts: list[str | None], a_path: str, b_path: str):
        encoder, a_length = side_a(a_path)
        words = pieces.words_of(b_path)
        spelt, _ = pieces.spellings(b_path)
        raw = [b" " + t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        b, b_sizes = pieces.encode_texts(texts, words)
        taken = spelt.take(pa.array(b))
        edges = np.frombuffer(taken.buffers()[1], np.int64)[: len(b) + 1] if len(b) else np.zeros(1, np.int64)
        written = np.frombuffer(taken.buffers()[2], np.uint8) if len(b) else np.zeros(0, np.uint8)
        until = edges[np.concatenate([[0], np.cumsum(b_sizes)])]
        if len(written) != len(data) or (until != offsets).any() or (written != data).any():
            good = np.array([written[until[k] : until[k + 1]].tobytes() == raw[k] for k in range(len(raw))], bool)
            b, b_sizes = b[np.repeat(good, b_sizes)], np.where(good, b_sizes, 0)
            raw = [r if g else b"" for r, g in zip(raw, good)]
            data = np.frombuffer(b"".join(raw), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        if len(data):
            a, a_sizes, _, _ = bpe.encode_chunk(data, offsets, encoder)
        else:
            a, a_sizes = np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        b_length = np.diff(np.frombuffer(spelt.buffers()[1], np.int64)[: len(spelt) + 1])
        self.n_a, self.n_b = len(a_length), len(spelt)
        self.a, self.b, self.a_sizes, self.b_sizes = a, b, a_sizes, b_sizes
        x, y = common_ends(np.cumsum(a_length[a]), a_sizes, np.cumsum(b_length[b]), b_sizes)
        #: Tokens of A and of B in each group, and the group's text.
        self.in_a, self.in_b = np.diff(x, prepend=-1), np.diff(y, prepend=-1)
        self.a_until, self.b_until = x + 1, y + 1
        self.text = np.searchsorted(np.cumsum(a_sizes), x, "right")
        self.n_groups = np.bincount(self.text, minlength=len(texts))
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, self.text, self.in_a * self.in_b)

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, written ``a1,a2|b1;a3|b2``; '' without tokens."""
        total = len(self.a) + len(self.b)
        index = np.empty(total, np.int64)
        a_last, b_last = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_last[self.a_until - 1], b_last[self.b_until - 1] = 1, 1
        index[np.arange(len(self.a)) + np.repeat(self.b_until - self.in_b, self.in_a)] = 2 * self.a.astype(np.int64) + a_last
        index[np.arange(len(self.b)) + np.repeat(self.a_until, self.in_b)] = 2 * self.n_a + 2 * self.b.astype(np.int64) + b_last
        taken = _numerals(self.n_a, self.n_b).take(pa.array(index))
        if not total:
            return [""] * len(self.a_sizes)
        edges = np.frombuffer(taken.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(self.a_sizes + self.b_sizes)])].tolist()
        view = memoryview(taken.buffers()[2])
        return [hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edges, edges[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, pairs (A id times ``n_b`` plus B id) and how often each is linked there; sorted, each once."""
        size = self.in_a * self.in_b
        narrow = np.flatnonzero(size <= WIDE)
        counts, in_b = size[narrow], self.in_b[narrow]
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        across = np.repeat(in_b, counts)
        a = self.a[np.repeat(self.a_until[narrow] - self.in_a[narrow], counts) + nth // across]
        b = self.b[np.repeat(self.b_until[narrow] - in_b, counts) + nth % across]
        keys = [np.repeat(self.text[narrow], counts) << 32 | (a.astype(np.int64) * self.n_b + b)]
        often = [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(size > WIDE).tolist():
            a, many_a = np.unique(self.a[self.a_until[g] - self.in_a[g] : self.a_until[g]], return_counts=True)
            b, many_b = np.unique(self.b[self.b_until[g] - self.in_b[g] : self.b_until[g]], return_counts=True)
            keys.append((self.text[g] << 32 | (a.astype(np.int64)[:, None] * self.n_b + b)).ravel())
            often.append((many_a[:, None] * many_b).ravel())
        key, weight = np.concatenate(keys), np.concatenate(often)
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, weight = key[first], np.add.reduceat(weight, first) if len(first) else weight
        return key >> 32, key & 0xFFFFFFFF, weight


def align(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), a: str = DEFAULT_A, b: str = DEFAULT_B) -> DataFrame:
    """Columns ``keep``, ``a_ids``, ``b_ids`` and, for each group, how many ids of each it takes: ``a_counts``, ``b_counts``."""
    common.arrow_batches(docs.sparkSession)
    keep = tuple(dict.fromkeys(keep))
    own, names = [docs.schema[c] for c in keep], ["a_ids", "b_ids", "a_counts", "b_counts"]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep))
            for x, y in common.chunks(common.text_bytes(texts)[1]):
                done = Aligned(texts.slice(x, y - x).to_pylist(), a, b)
                made = [(done.a, done.a_sizes), (done.b, done.b_sizes), (done.in_a, done.n_groups), (done.in_b, done.n_groups)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(x, y - x) for k in range(len(keep))), *(bpe._list_array(v.astype(np.int32), s) for v, s in made)], [*keep, *names])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, T.StructType([*own, *(T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in names)]))


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2**32 by byte planes, which shuffles and files compress well."""
    return np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _shares(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Every document with its figures and its links as places in its share's list of pairs, and one row of pairs for each share.

    ``share`` is unique in one written table, so the result is written before it is used.
    """
    common.arrow_batches(docs.sparkSession)
    schema = T.StructType.fromDDL(f"share long, doc_id long, {DOCUMENT}, places binary, often binary, pairs array<int>, held array<int>")

    def run(batches):
        number, size, kept = TaskContext.get().partitionId() << 24, 0, []

        def close():
            nonlocal number, size, kept
            text, pair, often = (np.concatenate(x) for x in zip(*(k[2] for k in kept)))
            own, place, held = np.unique(pair, return_inverse=True, return_counts=True)
            at = 0
            for ids, rows, (t, _, _) in kept:
                n = len(ids)
                edges = at + np.searchsorted(t, np.arange(n + 1))
                at += len(t)
                places = [_packed(np.diff(place[x:y], prepend=0)) for x, y in zip(edges.tolist(), edges[1:].tolist())]
                counts = [_packed(often[x:y] - 1) for x, y in zip(edges.tolist(), edges[1:].tolist())]
                yield _batch([pa.array(np.full(n, number)), ids, *rows, pa.array(places, pa.binary()), pa.array(counts, pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int32()))])
            one = [bpe._list_array(x.astype(np.int32), np.array([len(x)])) for x in (own, held)]
            yield _batch([pa.array([number]), *(pa.nulls(1, t) for t in (pa.int64(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())), *one])
            number, size, kept = number + 1, 0, []

        names = schema.fieldNames()
        _batch = lambda columns: pa.RecordBatch.from_arrays(columns, names)
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            offsets = common.text_bytes(texts)[1]
            for x, y in common.chunks(offsets):
                done = Aligned(texts.slice(x, y - x).to_pylist(), a, b)
                rows = [pa.array(v.astype(np.int64)) for v in (done.a_sizes, done.b_sizes, done.n_groups, done.n_links)]
                kept.append((ids.slice(x, y - x), [*rows, pa.array(done.digests(), pa.string())], done.links()))
                size += int(offsets[y] - offsets[x])
                if size >= SHARE_BYTES:
                    yield from close()
        if kept:
            yield from close()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _counted(shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(share, pair, held) of every share, and (pair, documents) of the corpus."""
    held = shares.filter("pairs is not null").select("share", F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("share", "x.pairs", "x.held").withColumnRenamed("pairs", "pair")
    return held, held.groupBy("pair").agg(F.sum("held").alias("documents"))


def _graded(counts: DataFrame, b: str) -> DataFrame:
    """(pair, documents, best): whether the count is the highest of the pair's A id. Highest counts are one row an id of A."""
    counts = counts.withColumn("a", F.floor(F.col("pair") / F.lit(len(pieces.spellings(b)[0]))).cast("int"))
    top = counts.groupBy("a").agg(F.max("documents").alias("top"))
    return counts.join(F.broadcast(top), "a").select("pair", "documents", (F.col("documents") == F.col("top")).alias("best"))


def pair_counts(docs: DataFrame, a: str = DEFAULT_A, b: str = DEFAULT_B) -> DataFrame:
    """a_id, b_id, documents that hold the pair linked, and whether no other pair of the A id has more."""
    n_b = F.lit(len(pieces.spellings(b)[0]))
    graded = _graded(_counted(common.materialise(_shares(docs, a, b), "alignment"))[1], b)
    return graded.select(F.floor(F.col("pair") / n_b).cast("int").alias("a_id"), (F.col("pair") % n_b).cast("int").alias("b_id"), "documents", "best")


def linked(docs: DataFrame, a: str = DEFAULT_A, b: str = DEFAULT_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    shares = common.materialise(_shares(docs, a, b), "alignment")
    held, counts = _counted(shares)
    answers = held.select("share", "pair").join(_graded(counts, b), "pair")
    rows = shares.filter("pairs is null").drop("pairs", "held").withColumnRenamed("share", "dealt")
    schema = T.StructType.fromDDL("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def settle(documents: pa.Table, answer: pa.Table) -> pa.Table:
        order = np.argsort(answer["pair"].to_numpy())
        count = answer["documents"].to_numpy()[order]
        best = answer["best"].to_numpy()[order].astype(np.int64)
        n_best, sums = [], []
        for places, often in zip(documents["places"].to_pylist(), documents["often"].to_pylist()):
            place, many = np.cumsum(_unpacked(places)), _unpacked(often) + 1
            n_best.append(int((best[place] * many).sum()))
            sums.append(int((count[place] * many).sum()))
        own = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table({f.name: own[f.name] if f.name in own else documents[f.name] for f in schema})

    return rows.groupBy("dealt").cogroup(answers.groupBy("share")).applyInArrow(settle, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"))
