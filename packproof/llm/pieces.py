"""SentencePiece encoding and decoding of merge-type models, by backtracking.

A sequence of pieces is the result of the merges if every two neighbours, joined and merged
again, come apart where they were joined: the first merge across one of the other borders
would have happened in that pair too. So the sequence is searched instead of merged:

* an Aho-Corasick automaton over the reversed pieces walks the reversed text and gives the
  longest piece that begins at each position; a chain leads from each piece to the next
  shorter one that begins it;
* from the front, the longest piece is taken that fits the one before; fits are found by
  merging the two again and are kept in a table of fixed size;
* where no piece fits, the position is marked in a bitfield of failed positions, never to be
  tried again, and the piece before gives way to a shorter one. The encoding of a prefix is
  unique, so each position fails at most once and the search is linear.

No piece has a space after another character, so words (a run of spaces and what follows)
are searched on their own; words of one chunk that the cache does not know are searched side
by side, one array operation a step. Characters without a piece become their bytes.

Cases: null reads as empty; an empty text has no ids and decodes to an empty text; equal
texts have equal ids; duplicated rows stay; every other column of the input is ignored
except those named in ``keep``. U+2581 in a text is a space to the model and decodes to one.
Null ids decode to an empty text; ids outside the model are an error. A batch of rows is
worked off in chunks of ``CHUNK_BYTES``; a longer text is a chunk of its own, so memory
follows the longest text.
"""

from __future__ import annotations

import codecs
import functools
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from . import bpe, common

DEFAULT_MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Words up to this length are searched side by side.
LONG = 48
#: The cache of words starts afresh after so many; slots of the table of fits, a power of two.
CACHE_SIZE, FITS = 400_000, 1 << 20
#: Positions that one lane of the automaton walks.
LANE = 64
NONE = np.int32(-1)
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


class Table:
    """Fixed map from long keys (not negative) to int values, asked with arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = self.slot(keys)
        while len(keys):  # of those that want a free slot, the last written one gets it
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 for others."""
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Matches:
    """Aho-Corasick automaton over reversed pieces: the longest piece that begins at each position."""

    def __init__(self, pieces: dict[str, int]):
        alphabet = sorted(set("".join(pieces)))
        self.letter = np.zeros(0x110001, np.int64)  # 0 is no letter of any piece; the last entry separates words
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.shift = len(alphabet).bit_length()
        self.longest_piece = max(map(len, pieces))
        number = {c: k for k, c in enumerate(alphabet, 1)}
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for piece, k in pieces.items():
            node = 0
            for c in reversed(piece):
                to = children[node].get(number[c])
                if to is None:
                    to = children[node][number[c]] = len(children)
                    children.append({})
                    ends.append(-1)
                node = to
            ends[node] = k
        fail = [0] * len(children)
        queue = list(children[0].values())
        for node in queue:  # by depth
            for c, to in children[node].items():
                back = fail[node]
                while back and c not in children[back]:
                    back = fail[back]
                fail[to] = children[back].get(c, 0)
                queue.append(to)
            if ends[node] < 0:  # the longest piece that ends here belongs to a shorter suffix
                ends[node] = ends[fail[node]]
        self.fail, self.ends = np.array(fail, np.int32), np.array(ends, np.int32)
        edges = [(node << self.shift | c, to) for node, row in enumerate(children) for c, to in row.items()]
        keys, to = np.array(edges, np.int64).T
        self.goto = Table(keys, to.astype(np.int32))
        self.root = np.zeros(len(alphabet) + 1, np.int32)
        for c, node in children[0].items():
            self.root[c] = node

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out = self.root[letter]
        on = np.flatnonzero((state > 0) & (letter > 0))
        state, letter = state[on], letter[on]
        while len(on):
            to = self.goto((state.astype(np.int64) << self.shift) | letter)
            hit = to >= 0
            out[on[hit]] = to[hit]
            state, letter, on = self.fail[state[~hit]], letter[~hit], on[~hit]
            more = state > 0
            state, letter, on = state[more], letter[more], on[more]
        return out

    def __call__(self, points: np.ndarray) -> np.ndarray:
        """Longest piece from each code point of a stream (0x110000 separates words), -1 for none.

        Lanes of ``LANE`` positions are walked together; each first walks as many positions
        before it as the longest piece has, after which its state no longer depends on the start.
        """
        n, before = len(points), self.longest_piece
        lanes = -(-n // LANE)
        letters = np.zeros(before + lanes * LANE, np.int64)
        letters[before : before + n] = self.letter[points[::-1]]
        grid = np.lib.stride_tricks.sliding_window_view(letters, before + LANE)[::LANE].T
        state = np.zeros(lanes, np.int32)
        out = np.empty((LANE, lanes), np.int32)
        for k in range(before + LANE):
            state = self._step(state, np.ascontiguousarray(grid[k]))
            if k >= before:
                out[k - before] = self.ends[state]
        return out.T.ravel()[:n][::-1]


class Model:
    """Pieces of a merge-type model that neither normalises nor drops spaces and falls back to bytes."""

    def __init__(self, path: str):
        source = SentencePieceProcessor(model_file=path)
        if source.normalize("  ﬁ A") != f"{SPACE}{SPACE}{SPACE}ﬁ{SPACE}A":
            raise ValueError("only models that keep the text and put a space before it")
        self.n = source.vocab_size()
        ids = range(self.n)
        plain = [k for k in ids if not (source.is_unknown(k) or source.is_control(k) or source.is_byte(k) or source.is_unused(k))]
        self.piece = {source.id_to_piece(k): k for k in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.piece) or not set("".join(self.piece)) <= set(self.piece):
            raise ValueError("only models whose pieces have spaces in front and whose characters are pieces")
        self.byte_ids = np.zeros(256, np.int32)
        for k in ids:
            if source.is_byte(k):
                self.byte_ids[int(source.id_to_piece(k)[3:5], 16)] = k
        # Merges go by falling score; equal scores are equal, so that the leftmost goes first.
        scores = np.array([source.get_score(k) for k in ids])
        self.order = np.append(np.unique(-scores, return_inverse=True)[1], self.n + 1).astype(np.int32)
        self.pairs = bpe.Pairs(self.piece)
        self.character = np.full(0x110001, self.n, np.int32)  # id n: a character without a piece
        self.length = np.ones(self.n + 1, np.int64)
        for p, k in self.piece.items():
            self.length[k] = len(p)
            if len(p) == 1:
                self.character[ord(p)] = k
        width = int(self.length.max())
        self.spelt = np.zeros((self.n + 1, width), np.int32)
        for p, k in self.piece.items():
            self.spelt[k, : len(p)] = self.character[[ord(c) for c in p]]
        own = self.merged_again(np.array(plain), None)
        kept = {p: k for p, k in self.piece.items() if own[k]}
        self.shorter = np.full(self.n + 1, NONE)
        for p, k in self.piece.items():
            self.shorter[k] = next((kept[p[:m]] for m in range(len(p) - 1, 0, -1) if p[:m] in kept), NONE)
        self.matches = Matches(kept)
        self.fit_keys, self.fit = np.full(FITS, -1, np.int64), np.zeros(FITS, bool)

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of pieces of one length, the best neighbours first: rows and how many pieces each has left."""
        many, n = ids.shape
        left = np.full(many, n)
        out = ids.copy()
        rows = np.arange(many)
        for width in range(n, 1, -1):
            joined = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
            joined = np.minimum(joined, self.n)
            cost = self.order[joined]
            at = cost.argmin(1)
            every = np.arange(len(rows))
            on = cost[every, at] <= self.n
            out[rows[~on], :width] = ids[~on]
            left[rows[~on]] = width
            rows, ids, at, made = rows[on], ids[on], at[on], joined[every, at][on]
            if not len(rows):
                return out, left
            column = np.arange(width - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            ids[np.arange(len(rows)), at] = made
        out[rows, :1], left[rows] = ids, 1
        return out, left

    def merged_again(self, a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        """Whether pieces a and b, spelt out and merged, are a and b again; without b, by id, whether a is a again."""
        good = np.zeros(len(a) if b is not None else self.n + 1, bool)
        size = self.length[a] + (self.length[b] if b is not None else 0)
        for n in np.unique(size):
            some = np.flatnonzero(size == n)
            x = a[some]
            column = np.arange(n)
            spelt = np.take_along_axis(self.spelt[x], np.minimum(column, self.spelt.shape[1] - 1)[None], 1)
            if b is None:
                out, left = self._merge(spelt)
                good[x] = (left == 1) & (out[:, 0] == x)
                continue
            y, cut = b[some], self.length[x][:, None]
            spelt = np.where(column < cut, spelt, np.take_along_axis(self.spelt[y], np.clip(column - cut, 0, self.spelt.shape[1] - 1), 1))
            out, left = self._merge(spelt)
            good[some] = (left == 2) & (out[:, 0] == x) & (out[:, 1] == y)
        return good

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b may follow a; nothing (-1) and characters without a piece fit everything."""
        key = a.astype(np.int64) << 32 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (FITS.bit_length() - 1))).astype(np.int64)
        good = self.fit[slot]
        free = (a < 0) | (a == self.n) | (b == self.n)
        unknown = np.flatnonzero((self.fit_keys[slot] != key) & ~free)
        if len(unknown):
            fresh, where = np.unique(key[unknown], return_inverse=True)
            found = self.merged_again((fresh >> 32).astype(np.int64), fresh & 0xFFFFFFFF)
            good[unknown] = found[where]
            self.fit_keys[slot[unknown]], self.fit[slot[unknown]] = key[unknown], good[unknown]
            # of two keys of one slot the last written one stays; both entries must come from it
            self.fit[slot[unknown]] = found[np.searchsorted(fresh, self.fit_keys[slot[unknown]])]
        return good | free

    def _search_together(self, starts: np.ndarray, ends: np.ndarray, longest: np.ndarray, taken: np.ndarray) -> None:
        """Write each word's pieces into ``taken`` at the positions where they begin."""
        failed = np.zeros(len(longest) + 1, bool)
        last = np.full(len(longest) + 1, NONE)  # the piece that ends before each position
        at, end, start = starts.copy(), ends, starts
        piece = longest[at]
        while len(at):
            tried = piece >= 0
            # nothing is left to try here: mark the position and let the piece before it give way
            dead = np.flatnonzero(~tried)
            if len(dead):
                failed[at[dead]] = True
                gone = last[at[dead]]
                at[dead] -= self.length[gone]
                taken[at[dead]] = NONE
                piece[dead] = self.shorter[gone]
            live = np.flatnonzero(tried)
            here, p = at[live], piece[live]
            there = here + self.length[p]
            before = np.where(here > start[live], last[here], NONE)
            good = ~failed[there]
            good[good] = self.fits(before[good], p[good])
            no = live[~good]
            piece[no] = self.shorter[piece[no]]
            yes = live[good]
            taken[here[good]], last[there[good]] = p[good], p[good]
            at[yes] = there[good]
            more = np.ones(len(at), bool)
            more[yes] = at[yes] < end[yes]
            on = yes[more[yes]]
            piece[on] = longest[at[on]]
            if not more.all():
                at, end, start, piece = at[more], end[more], start[more], piece[more]

    def _comes_apart(self, a: int, b: int) -> bool:
        """``fits`` for one pair."""
        if a in (-1, self.n) or b == self.n:
            return True
        price, (x, y) = self._prices, (self._spelling[a], self._spelling[b])
        parts, cut = [*x, *y], len(x)
        while True:
            cost, at = min(((price.get(p + q, self.n), k) for k, (p, q) in enumerate(zip(parts, parts[1:]))))
            if cost >= self.n:
                return cut == 1 and len(parts) == 2
            if at == cut - 1:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            cut -= at < cut

    def _search_one(self, longest: list[int], known: dict[tuple[int, int], bool]) -> list[int]:
        """The same for one long word: its pieces by position, -1 between."""
        n = len(longest)
        failed = bytearray((n >> 3) + 1)
        path, at, piece = [], 0, longest[0]
        length, shorter = self._lists
        while at < n:
            while piece >= 0:
                there = at + length[piece]
                if not failed[there >> 3] >> (there & 7) & 1:
                    pair = (path[-1] if path else -1, piece)
                    if (good := known.get(pair)) is None:
                        good = known[pair] = self._comes_apart(*pair)
                    if good:
                        break
                piece = shorter[piece]
            if piece >= 0:
                path.append(piece)
                at = there
                piece = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                gone = path.pop()
                at -= length[gone]
                piece = shorter[gone]
        out = [-1] * n
        at = 0
        for p in path:
            out[at] = p
            at += length[p]
        return out

    @functools.cached_property
    def _prices(self) -> dict[str, int]:
        return {p: int(self.order[k]) for p, k in self.piece.items()}

    @functools.cached_property
    def _spelling(self) -> dict[int, str]:
        return {k: p for p, k in self.piece.items()}

    @functools.cached_property
    def _lists(self) -> tuple[list[int], list[int]]:
        return self.length.tolist(), self.shorter.tolist()

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        spread = np.full(len(points) + len(words), 0x110000, np.int64)
        where = np.arange(len(points)) + np.repeat(np.arange(len(words)), sizes)
        spread[where] = points
        longest = self.matches(spread)[where]
        longest = np.where(longest < 0, self.n, longest)
        taken = np.full(len(points), NONE)
        short = np.flatnonzero(sizes <= LONG)
        self._search_together(starts[short], ends[short], longest, taken)
        known: dict[tuple[int, int], bool] = {}
        for k in np.flatnonzero(sizes > LONG).tolist():
            a, b = int(starts[k]), int(ends[k])
            taken[a:b] = self._search_one(longest[a:b].tolist(), known)
            if len(known) > CACHE_SIZE:
                known.clear()
        begins = np.flatnonzero(taken >= 0)
        ids = taken[begins]
        bare = ids == self.n
        width = np.ones(len(ids), np.int64)
        if bare.any():  # characters without a piece become their bytes
            own = points[begins[bare]]
            raw = np.frombuffer(own.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            width[bare] = 1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF)
            spans = np.repeat(bare, width)
            ids = np.repeat(ids, width)
            ids[spans] = self.byte_ids[raw]
        until = np.concatenate([[0], np.cumsum(width)])
        return ids, until[np.searchsorted(begins, ends)] - until[np.searchsorted(begins, starts)]


class Words(dict):
    """Number of each word met so far; ``ids`` and ``ends`` hold the ids by number; emptied when it is large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.drop()

    def drop(self) -> None:
        self.clear()
        self.ids, self.ends = array("i"), array("q", [0])

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE_SIZE or len(self.ids) > 8 * CACHE_SIZE:
            self.drop()
        get = self.get
        got = np.array([get(w, -1) for w in words], np.int64)
        unknown = np.flatnonzero(got < 0).tolist()
        if unknown:
            fresh = list(dict.fromkeys(words[i] for i in unknown))
            ids, sizes = self.model.search(fresh)
            first = len(self.ends) - 1
            self.ids.frombytes(ids.astype(np.int32).tobytes())
            self.ends.extend((np.cumsum(sizes) + self.ends[-1]).tolist())
            self.update(zip(fresh, range(first, first + len(fresh))))
            got[unknown] = [self[words[i]] for i in unknown]
        return got


@functools.cache
def words_of(path: str) -> Words:
    return Words(Model(path))


def encode_texts(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and how many each has."""
    parts, counts = [], []
    for text in texts:
        found = _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else ()
        parts.extend(found)
        counts.append(len(found))
    got = words.numbers(parts)
    edges, flat = np.frombuffer(words.ends, np.int64), np.frombuffer(words.ids, np.int32) if len(words.ids) else np.zeros(0, np.int32)
    sizes = edges[got + 1] - edges[got]
    until = np.concatenate([[0], np.cumsum(sizes)])
    ids = flat[np.repeat(edges[got] - until[:-1], sizes) + np.arange(until[-1])]
    del edges, flat  # the arrays may grow again
    return ids, np.diff(until[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])])


@functools.cache
def spellings(path: str) -> tuple[pa.Array, np.ndarray]:
    """Bytes of each id as decoding writes them, and which ids begin with a space that a text's start drops."""
    source = SentencePieceProcessor(model_file=path)
    out, led = [], []
    for k in range(source.vocab_size()):
        piece = source.id_to_piece(k)
        if source.is_byte(k):
            out.append(bytes([int(piece[3:5], 16)]))
        elif source.is_control(k):
            out.append(b"")
        elif source.is_unknown(k):
            out.append(" ⁇ ".encode())
        else:
            out.append(piece.replace(SPACE, " ").encode())
        led.append(piece.startswith(SPACE))
    return pa.array(out, pa.large_binary()), np.array(led)


def _one_mark_a_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("packproof-one-mark-a-byte", _one_mark_a_byte)


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = DEFAULT_MODEL) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array<int>)."""
    common.arrow_batches(docs.sparkSession)
    keep = tuple(dict.fromkeys(keep))
    own = [docs.schema[c] for c in keep]

    def run(batches):
        words = words_of(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            _, at = common.text_bytes(texts)
            for a, b in common.chunks(at):
                ids, sizes = encode_texts(texts.slice(a, b - a).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), bpe._list_array(ids, sizes)], [*keep, "ids"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, T.StructType([*own, T.StructField("ids", T.ArrayType(T.IntegerType(), False))]))


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = DEFAULT_MODEL) -> DataFrame:
    """Columns ``keep`` and ``decoded``: the text of ``ids``, without the space put before it; bytes that are no character become U+FFFD, one each."""
    keep = tuple(dict.fromkeys(keep))
    own = [encoded.schema[c] for c in keep]

    def run(batches):
        spelt, led = spellings(model)
        for batch in batches:
            column = batch.column(len(keep))
            ids = column.flatten()
            if len(ids) and (pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(spelt)):
                raise ValueError("an id is not in the model")
            taken = spelt.take(ids)
            _, edges, data = taken.buffers()
            raw = data.to_pybytes() if data is not None else b""
            until = np.concatenate([[0], np.cumsum(_sizes(column))])
            first = ids.to_numpy()[np.minimum(until[:-1], max(0, len(ids) - 1))] if len(ids) else np.zeros(len(column), np.int64)
            drop = (until[1:] > until[:-1]) & led[first]
            edges = np.frombuffer(edges, np.int64)[taken.offset :][until]
            texts = [raw[a:b].decode("utf-8", "packproof-one-mark-a-byte") for a, b in zip((edges[:-1] + drop).tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], [*keep, "decoded"])

    return encoded.select(*keep, F.col("ids").alias("__ids")).mapInArrow(run, T.StructType([*own, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the text they decode to."""
    own = [F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256")]
    back = decode(encode(docs, ("doc_id",), model).select("doc_id", "ids", *own), ("doc_id", "n_tokens", "ids_sha256"), model)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
