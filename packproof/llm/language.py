"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. The
likelihood of a word is the sum over all its segmentations into pieces, by the forward
algorithm; words are independent, so a text's log-likelihood is a sum over its words.
Piece probabilities are learned by expectation maximisation: forward and backward sums
over the words of labelled texts give expected piece counts.

Words are runs without white space, in lower case, with everything but letters taken
out; a word's likelihoods are computed once per worker and kept while the cache lasts.
Words of like length go through the sums together: at every start a trie of the whole
vocabulary is followed for all of them at once. Words of any length are summed; those over
LONG bytes are rescaled at every position.

Learning reads a sample of about ``per_language`` labelled documents of each language,
drawn by a hash of ``doc_id`` (a documented bound: word statistics of a few thousand
documents settle the model), and words over CUT bytes in parts of that size. The LANGUAGES
most frequent values of ``lang`` are learned. Prediction reads every whole text. Its inputs
are texts only.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if
nothing could be learned; ties between languages go to the first in code-point order;
null or repeated ``doc_id`` is carried through; extra columns pass ``identify`` unchanged,
one named like an output is replaced.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

#: Scores are kept for so many words; words longer than LONG bytes are rescaled; learning cuts words at CUT bytes.
CACHE, LONG, CUT = 300_000, 48, 4096
#: Words, and bytes of them, that are summed at a time.
TOGETHER, BYTES = 5000, 1 << 19
PER_LANGUAGE, ROUNDS, LANGUAGES = 3000, 3, 256


def letters(word: str) -> bytes:
    """Lower-case letters of a word, after a mark for the word's start, as UTF-8."""
    word = word.lower()
    if not word.isalpha():
        word = "".join(c for c in word if c.isalpha())
    return b" " + word.encode("utf-8", "ignore") if word else b""


class Pieces:
    """Numbered pieces, and a trie of those that lower-case words can hold: node 0 is dead, node 1 the root."""

    def __init__(self, pieces: dict[bytes, int]):
        self.number, self.size = pieces, np.array([len(p) for p in pieces])
        able = [p for p in pieces if p == p.lower() and all(c >= 97 or c == 32 for c in p)]
        children: dict[tuple[int, int], int] = {}
        ends = []
        for piece in able:
            node = 1
            for byte in piece:
                node = children.setdefault((node, byte), len(children) + 2)
            ends.append(node)
        self.column = np.zeros(256, np.uint8)  # column 0 is for bytes that no piece has
        used = sorted({byte for _, byte in children})
        self.column[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.step = np.zeros((len(children) + 2) * self.width, np.int32)
        keys = np.array(list(children) or [(0, 0)], np.int64)
        self.step[keys[:, 0] * self.width + self.column[keys[:, 1]]] = np.array(list(children.values()) or [0], np.int32)
        self.longest = max(map(len, able), default=0)
        self.piece = np.full(len(children) + 2, -1, np.int32)
        self.piece[ends] = [pieces[p] for p in able]

    def __len__(self) -> int:
        return len(self.number)


@functools.cache
def vocabulary(path: str) -> Pieces:
    """All pieces, in order; every single byte is one of them."""
    return Pieces({p: k for k, p in enumerate(sorted(bpe.load_ranks(path)))})


def together(words: list[bytes]):
    """Places of words, longest first, in groups of like length; empty words are in none."""
    order = sorted((k for k, w in enumerate(words) if w), key=lambda k: -len(words[k]))
    while order:
        n = max(1, min(TOGETHER, BYTES // len(words[order[0]])))
        if len(words[order[0]]) > LONG:  # rescaled ones by themselves
            n = min(n, next((k for k, w in enumerate(order) if len(words[w]) <= LONG), n))
        yield order[:n]
        order = order[n:]


def forward(words: list[bytes], pieces: Pieces, probability: np.ndarray, keep: bool = False):
    """Log of the summed probability of all segmentations of each word, (words, languages); words come longest first.

    With ``keep`` also what ``expected_counts`` needs: by position the (words, languages) sums,
    their logs where rescaled, and the edges (start, words, pieces, end).
    """
    n, longest = len(words), len(words[0])
    sizes = np.array([len(w) for w in words])
    grid = np.zeros((longest, n), np.uint8)
    grid.T[np.arange(longest) < sizes[:, None]] = pieces.column[np.frombuffer(b"".join(words), np.uint8)]
    living = n - np.searchsorted(sizes[::-1], np.arange(longest), "right")  # words longer than each position
    shape = (n, probability.shape[1])
    alpha, scale, edges = {0: np.ones(shape)}, np.zeros(shape), []
    logs, out, scaled = [], np.zeros(shape), longest > LONG
    for start in range(longest + 1):
        own = alpha.setdefault(start, np.zeros(shape))
        if scaled and start:
            total = np.where(own > 0, own, 1.0)
            scale += np.log(total)
            own = alpha[start] = own / total
            for end in range(start + 1, start + pieces.longest):
                if end in alpha:
                    alpha[end] /= total
        if keep:
            logs.append(scale.copy() if scaled else None)
        done = slice(living[start] if start < longest else 0, living[start - 1] if start else 0)
        with np.errstate(divide="ignore"):
            out[done] = np.log(own[done]) + scale[done]
        if start == longest:
            break
        live = np.arange(living[start])
        node = pieces.step[pieces.width + grid[start, : len(live)].astype(np.int64)].astype(np.int64)
        end = start + 1
        while True:
            alive = np.flatnonzero(node)
            if len(alive) < len(live):
                live, node = live[alive], node[alive]
            if not len(live):
                break
            piece = pieces.piece[node]
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                at, piece = (live, piece) if len(hit) == len(live) else (live[hit], piece[hit])
                if end not in alpha:
                    alpha[end] = np.zeros(shape)
                alpha[end][at] += own[at] * probability[piece]
                if keep:
                    edges.append((start, at, piece, end))
            if end == longest:
                break
            node = pieces.step[node * pieces.width + grid[end, live]].astype(np.int64)
            end += 1
        if not keep:
            del alpha[start]
    return (out, alpha, logs, edges) if keep else out


def log_likelihoods(words: list[bytes], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """(words, languages) log-likelihoods; an empty word gives 0."""
    out = np.zeros((len(words), probability.shape[1]))
    for group in together(words):
        out[group] = forward([words[k] for k in group], pieces, probability)
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Expected use of each piece, (pieces, languages), given each word's count by language."""
    out = np.zeros_like(probability)
    for group in together(words):
        part = [words[k] for k in group]
        _, alpha, logs, edges = forward(part, pieces, probability, True)
        passed = {}  # by position: how often a segmentation stops there, over the sum up to there
        sizes = np.array([len(w) for w in part])
        for size in np.unique(sizes).tolist():
            on = sizes == size
            passed[size] = np.where(on[:, None], counts[group], 0.0)
        at, uses, ready = [], [], set()
        for start, row, piece, end in reversed(edges):
            if end not in passed:
                continue
            if end not in ready:  # all edges out of ``end`` are done
                ready.add(end)
                passed[end] /= np.where(alpha[end] > 0, alpha[end], 1.0)
            use = alpha[start][row] * probability[piece] * passed[end][row]
            if logs[end] is not None:
                use *= np.exp(logs[start][row] - logs[end][row])
            at.append(piece)
            uses.append(use)
            if start not in passed:
                passed[start] = np.zeros_like(alpha[start])
            passed[start][row] += use
        if at:
            at, uses = np.concatenate(at), np.concatenate(uses)
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(at, uses[:, k], len(out))
    return out


def normalised(counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Probabilities from counts, smoothed by a little of all languages' mean and of a floor by piece length."""
    floor = 256.0 ** -(pieces.size - 1.0)[:, None]
    mean = counts.sum(1, keepdims=True) / max(counts.sum(), 1)
    own = counts / np.maximum(counts.sum(0), 1)
    out = 0.98 * own + 0.015 * mean + 0.005 * floor / floor.sum()
    return out / out.sum(0)


class Model:
    """Languages in order and the (pieces, languages) probabilities."""

    def __init__(self, languages: list[str], probability: np.ndarray | None, path: str):
        self.languages, self.probability, self.path = languages, probability, path


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, path: str = bpe.DEFAULT_VOCABULARY) -> Model:
    """Fit a model on columns text, lang and doc_id of about ``per_language`` documents of each language."""
    spark = labelled.sparkSession
    common.arrow_batches(spark)
    good = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequent = good.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    totals = {r[0]: r[1] for r in frequent.collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], None, path)
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / totals[lang])))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) / 1e6
    sample = good.filter(F.col("lang").isin(languages) & (F.isnull("doc_id") | (draw < share[F.col("lang")]))).select("lang", "text")

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(text.lower().split())
            rows: Counter = Counter()
            for lang, c in found.items():
                for word, n in c.items():
                    w = letters(word)
                    for a in range(0, len(w), CUT):
                        rows[lang, w[a : a + CUT]] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.binary()), pa.array(rows.values(), pa.int64())], ["lang", "word", "n"])

    counts = sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = common.materialise(counts, "language-words")
    pieces = vocabulary(path)
    number = {lang: k for k, lang in enumerate(languages)}
    probability = np.repeat((0.5 ** (8 * np.minimum(pieces.size, 2)) / len(pieces))[:, None], len(languages), 1)  # longer pieces first pay once
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(probability)  # vocabulary x languages

        def expect(batches, shared=shared):
            pieces = vocabulary(path)
            out = np.zeros_like(shared.value)
            for batch in batches:
                langs, words, n = (c.to_pylist() for c in batch.columns)
                use = np.zeros((len(words), len(number)))
                use[np.arange(len(words)), [number[x] for x in langs]] = n
                out += expected_counts(words, use, pieces, shared.value)
            piece, lang = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(out[piece, lang])], ["piece", "lang", "n"])

        # at most vocabulary x languages rows come back, however large the input
        rows = counts.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        fresh = np.zeros_like(probability)
        fresh[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
        probability = normalised(fresh, pieces)
    return Model(languages, probability, path)


class Scorer:
    """Log-likelihoods of texts, with those of words kept."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, vocabulary(model.path)
        self.drop()

    def drop(self) -> None:
        self.known: dict[str, int] = {}  # words as they stand
        self.bare: dict[bytes, int] = {}  # their letters
        self.table = np.zeros((1 << 16, len(self.model.languages)))

    def learn(self, new: list[str]) -> None:
        bare = [letters(w) for w in new]
        fresh = [w for w in dict.fromkeys(bare) if w not in self.bare]
        first = len(self.bare)
        while first + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(fresh)] = log_likelihoods(fresh, self.pieces, self.model.probability)
        self.bare.update(zip(fresh, range(first, first + len(fresh))))
        self.known.update((w, self.bare[x]) for w, x in zip(new, bare))

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.drop()
        split = [t.lower().split() for t in texts]
        new = set()
        for words in split:
            new.update(words)
        new.difference_update(self.known)
        if new:
            self.learn(list(new))
        known = self.known
        flat = np.array([known[w] for words in split for w in words], np.int64)
        sizes = np.array([len(w) for w in split])
        out = np.zeros((len(texts), len(self.model.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            edges = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            out[some] = np.add.reduceat(self.table[flat], edges[some])
        return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of the predicted language."""
    common.arrow_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        model = shared.value
        scorer = Scorer(model) if model.languages else None
        for batch in batches:
            data, at = common.text_bytes(batch.column(batch.num_columns - 1))
            for a, b in common.chunks(at):
                texts = [data[at[k] : at[k + 1]].tobytes().decode("utf-8") for k in range(a, b)]
                lettered = np.array([any(map(str.isalpha, t)) for t in texts]) if scorer else np.zeros(b - a, bool)
                label, score = ["und"] * (b - a), np.zeros(b - a)
                if scorer:
                    logs = scorer(texts)
                    best = logs.argmax(1)
                    score = np.where(lettered, 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), 0.0)
                    label = [model.languages[x] if ok else "und" for x, ok in zip(best.tolist(), lettered.tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(own))), pa.array(label, pa.string()), pa.array(score)], schema.names)

    return docs.select(*own, F.col("text").alias("__text")).mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs.filter(~F.coalesce(held_out(), F.lit(True))).select("doc_id", "lang", "text"))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
