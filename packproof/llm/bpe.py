"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is a finite-state transducer over code-point classes. Transition
functions compose associatively, so token starts come from a blocked scan: every block
composes the functions of its code points, the block functions are folded, and each
block is replayed from its entry state. All texts of a chunk are scanned together.
The slices between starts go through a cache of merged pieces. Their ends, as byte offsets
into the text, are kept beside the ids; decoding puts the bytes of the ids between them and
fails if an end does not fall between two ids or the last one is not the end of the text.

Cases: null reads as empty; an empty text has no ids and decodes to no bytes; equal
texts have equal ids; duplicated rows stay; every other column of the input is ignored
except those named in ``keep``. A batch of rows is worked off in chunks of
``CHUNK_BYTES``; a longer text is a chunk of its own, so memory follows the longest text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces up to this length are merged in batches; the cache starts afresh after so many entries.
CACHE_PIECE, CACHE_SIZE = 48, 400_000
BLOCK = 64

# Code-point classes, then the symbols that one code point of lookahead makes of them.
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
GLUE, LONE, QUOTE2, QUOTE3, RESET = 4, 5, 6, 7, 8  # ' ' before a token; other last space; 's; 're; text start
# States: inside a run of letters, numbers, others or spaces; after glue; 1 or 2 left of a contraction; at a start.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_GLUE, S_ONE, S_TWO, S_NEW = range(8)
N_STATES = 8


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


@functools.cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token starts here", by symbol and state."""
    step = np.zeros((9, N_STATES), np.uint8)
    begins = np.zeros((9, N_STATES), bool)
    run = {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER, SPACE: S_SPACE, GLUE: S_GLUE, LONE: S_NEW}
    for state in range(N_STATES):
        for symbol, to in run.items():
            step[symbol, state] = to
            begins[symbol, state] = not (state == to and symbol in (LETTER, NUMBER, OTHER, SPACE)) and not (state == S_GLUE and symbol in (LETTER, NUMBER, OTHER))
        for symbol, left in ((QUOTE2, S_ONE), (QUOTE3, S_TWO)):
            open_run = state in (S_OTHER, S_GLUE)  # there the quote belongs to a run of others
            step[symbol, state] = S_OTHER if open_run else left
            begins[symbol, state] = not open_run
        step[RESET, state] = S_NEW
        begins[RESET, state] = True
        if state in (S_ONE, S_TWO):  # the rest of a contraction
            step[: RESET, state] = S_ONE if state == S_TWO else S_NEW
            begins[: RESET, state] = False
    return step, begins


def symbols(points: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``reset`` marks separators between texts."""
    kind = classes()[points]
    kind[reset] = RESET
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    after[-1] = RESET
    last = (kind == SPACE) & (after != SPACE) & (after != RESET)
    out = np.where(last, np.where(points == 32, GLUE, LONE), kind).astype(np.uint8)
    quotes = np.flatnonzero((points == 39) & ~reset)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[quotes[two]] = QUOTE2
        out[quotes[three]] = QUOTE3
    return out


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """Positions where a token starts, by a blocked scan of transition functions."""
    step, begins = transitions()
    n = len(symbol)
    pad = -n % BLOCK
    grid = np.concatenate([symbol, np.full(pad, RESET, np.uint8)]).reshape(-1, BLOCK).T.copy()
    flat = step.ravel()
    function = np.tile(np.arange(N_STATES, dtype=np.uint8), (grid.shape[1], 1))
    for row in grid:  # compose each block's functions, all blocks at once
        function = flat[row.astype(np.uint16)[:, None] * N_STATES + function]
    entry = np.empty(grid.shape[1], np.uint8)
    state = S_NEW
    for k, f in enumerate(function.tolist()):
        entry[k] = state
        state = f[state]
    marks = np.empty(grid.shape, bool)
    table = begins.ravel()
    state = entry
    for k, row in enumerate(grid):
        at = row.astype(np.uint16) * N_STATES + state
        marks[k] = table[at]
        state = flat[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: join the neighbours of lowest rank, leftmost first, until none is left."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    ends = list(range(1, n + 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[i], ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        if not alive[i] or ends[i] != middle or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j] = False
        ends[i], after[i] = end, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return tuple(ranks[piece[i : ends[i]]] for i in range(n) if alive[i])


class Pairs:
    """Merged rank of every pair of ids, as an open-addressing table that answers arrays of pairs."""

    NONE = np.int32(1 << 30)

    def __init__(self, ranks: dict[bytes, int]):
        a, b, c = [], [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                if (x := ranks.get(piece[:cut])) is not None and (y := ranks.get(piece[cut:])) is not None:
                    a.append(x), b.append(y), c.append(rank)
        self.bits = max(8, int(len(a) * 5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.NONE, np.int32)
        key, rank = self.key(np.array(a, np.int64), np.array(b, np.int64)), np.array(c, np.int32)
        slot = self.slot(key)
        while len(key):  # of those that want a free slot, the last written one gets it
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key
            self.ranks[slot[placed]] = rank[placed]
            key, rank, slot = key[~placed], rank[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 32) | b

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none or where ``b`` is -1."""
        key = self.key(a, b)
        slot = self.slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], self.NONE)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        out[b < 0] = self.NONE
        return out


def merge_batch(group: list[bytes], pairs: Pairs, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``merge`` for many pieces of one length at once: ids, and how many each piece has."""
    n = len(group[0])
    ids = byte_ids[np.frombuffer(b"".join(group), np.uint8).reshape(-1, n)]
    cost = pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, n - 1)
    rows = np.arange(len(ids))
    out = ids.copy()
    for width in range(n, 1, -1):
        at = cost.argmin(1)
        least = cost[np.arange(len(rows)), at]
        on = least < Pairs.NONE
        if not on.all():
            out[rows[~on], :width] = ids[~on]
            out[rows[~on], width:] = -1
            rows, ids, cost, at, least = rows[on], ids[on], cost[on], at[on], least[on]
        if not len(rows):
            break
        every, column = np.arange(len(rows)), np.arange(width - 1)
        ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
        ids[every, at] = least
        cost = np.take_along_axis(cost, column[:-1] + (column[:-1] >= at[:, None]), 1)
        right = np.flatnonzero(at < width - 2)
        cost[right, at[right]] = pairs(ids[right, at[right]], ids[right, at[right] + 1])
        left = np.flatnonzero(at > 0)
        cost[left, at[left] - 1] = pairs(ids[left, at[left] - 1], ids[left, at[left]])
        if width == 2:
            out[rows, :1] = ids
            out[rows, 1:] = -1
    keep = out >= 0
    return out[keep], keep.sum(1)


class Pieces(dict):
    """Number of each piece met so far; ``ids`` and ``ends`` hold the ids by number.

    ``numbers`` empties it before a chunk once it is large, so its size is bounded.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.drop()

    def drop(self) -> None:
        self.clear()
        self.ids, self.ends = array("i"), array("q", [0])

    def _add(self, piece: bytes, ids) -> None:
        self[piece] = len(self.ends) - 1
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def numbers(self, parts: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_SIZE or len(self.ids) > 8 * CACHE_SIZE:
            self.drop()
        get = self.get
        got = np.array([get(p, -1) for p in parts], np.int64)
        unknown = np.flatnonzero(got < 0).tolist()
        groups: dict[int, list[bytes]] = {}
        for piece in dict.fromkeys(parts[i] for i in unknown):
            if (rank := self.ranks.get(piece)) is not None:
                self._add(piece, (rank,))
            elif len(piece) <= CACHE_PIECE:
                groups.setdefault(len(piece), []).append(piece)
            else:
                self._add(piece, merge(piece, self.ranks))
        for group in groups.values():
            ids, sizes = merge_batch(group, self.pairs, self.byte_ids)
            self.ids.frombytes(ids.tobytes())
            first = len(self.ends) - 1
            self.ends.extend((np.cumsum(sizes) + self.ends[-1]).tolist())
            self.update(zip(group, range(first, first + len(group))))
        got[unknown] = [self[parts[i]] for i in unknown]
        return got


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(load_ranks(path))


@functools.cache
def tokens_of(path: str) -> pa.Array:
    """Bytes of each id."""
    ranks = load_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return pa.array(out, pa.large_binary())


def encode_chunk(data: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of consecutive texts: ids, ids of each text, piece ends in bytes, pieces of each text."""
    n = len(offsets) - 1
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    raw = part.tobytes()
    lead = (part & 0xC0) != 0x80  # bytes that begin a code point
    at = np.flatnonzero(lead)
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    # A separator stands before each text; it is the only symbol that is not a code point.
    text_of = np.searchsorted(at, offsets[:-1] - base)
    m = len(points)
    where = np.arange(m, dtype=np.int64)
    shift = np.zeros(m + 1, np.int64)
    np.add.at(shift, text_of, 1)
    where += np.cumsum(shift)[:m]
    spread = np.zeros(m + n, np.uint32)
    reset = np.ones(m + n, bool)
    spread[where] = points
    reset[where] = False
    byte = np.empty(m + n, np.int64)
    byte[where] = at
    starts = token_starts(symbols(spread, reset))
    starts = byte[starts[~reset[starts]]]
    first = np.searchsorted(starts, offsets - base)
    ends = np.append(starts[1:], len(part))
    got = pieces.numbers([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
    edges, flat = np.array(pieces.ends), np.array(pieces.ids, np.int32)
    sizes = edges[got + 1] - edges[got]
    until = np.concatenate([[0], np.cumsum(sizes)])
    ids = flat[np.repeat(edges[got] - until[:-1], sizes) + np.arange(until[-1])]
    # piece ends are relative to their own text
    counts = np.diff(first)
    ends = ends - np.repeat(offsets[:-1] - base, counts)
    return ids, np.diff(until[first]), ends.astype(np.int32), counts


def _list_array(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str = DEFAULT_VOCABULARY, offsets: bool = True) -> DataFrame:
    """Columns ``keep``, ``ids`` (array<int>), and with ``offsets`` also ``piece_ends``.

    ``piece_ends`` holds the end of every pre-token as a byte offset into the UTF-8 text.
    """
    common.arrow_batches(docs.sparkSession)
    keep = tuple(dict.fromkeys(keep))
    own = [docs.schema[c] for c in keep]
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] + [T.StructField("piece_ends", T.ArrayType(T.IntegerType(), False))] * offsets

    def run(batches):
        pieces = pieces_of(vocabulary)
        for batch in batches:
            data, at = common.text_bytes(batch.column(batch.num_columns - 1))
            for a, b in common.chunks(at):
                ids, sizes, ends, counts = encode_chunk(data, at[a : b + 1], pieces)
                columns = [batch.column(k).slice(a, b - a) for k in range(len(keep))] + [_list_array(ids, sizes)]
                if offsets:
                    columns.append(_list_array(ends, counts))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *(f.name for f in extra)])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, T.StructType(own + extra))


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``decoded`` (binary): the bytes that ``ids`` stand for; null ids give no bytes.

    Where ``encoded`` has ``piece_ends``, ids are put between them, and ids that do not fit are an error.
    """
    keep = tuple(dict.fromkeys(keep))
    own = [encoded.schema[c] for c in keep]
    offsets = "piece_ends" in encoded.columns

    def sizes_of(column: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches):
        for batch in batches:
            column = batch.column(len(keep))
            taken = tokens_of(vocabulary).take(column.flatten())
            if taken.null_count:
                raise ValueError("an id is not in the vocabulary")
            _, edges, data = taken.buffers()
            token_ends = np.frombuffer(edges, np.int64)[taken.offset : taken.offset + len(taken) + 1]
            edges = token_ends[np.concatenate([[0], np.cumsum(sizes_of(column))])].astype(np.int64)
            if offsets:
                ends = batch.column(len(keep) + 1)
                counts = sizes_of(ends)
                at = ends.flatten().to_numpy() + np.repeat(edges[:-1], counts)
                last = np.cumsum(counts) - 1
                reached = np.where(counts > 0, at[np.maximum(last, 0)] if len(at) else 0, edges[:-1])
                if (token_ends[np.minimum(np.searchsorted(token_ends, at), len(token_ends) - 1)] != at).any() or (reached != edges[1:]).any():
                    raise ValueError("ids do not fit the offsets of their text")
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(edges.tobytes()), data if data is not None else pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), made.cast(pa.binary())], [*keep, "decoded"])

    rows = encoded.select(*keep, F.col("ids").alias("__ids"), *([F.col("piece_ends").alias("__ends")] if offsets else []))
    return rows.mapInArrow(run, T.StructType([*own, T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the bytes they decode to, number of pieces between offsets."""
    encoded = encode(docs, ("doc_id",), vocabulary)
    own = [F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.size("piece_ends").cast("long").alias("n_pieces")]
    back = decode(encoded.select("doc_id", "ids", "piece_ends", *own), ("doc_id", "n_tokens", "ids_sha256", "n_pieces"), vocabulary)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_pieces")


def op3(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
