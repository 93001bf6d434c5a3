"""Language-model scoring by cross-entropy difference.

A target and a background model of word bigrams share one vocabulary: every word of the
documents that are counted. Background counts cover all documents, target counts the target
documents; background counts are scaled to the target's size, so that both models smooth
alike. A document's score is the mean, over its tokens, of target loss minus background loss
(in nats): negative is nearer the target.

Counts are exact and grow with the input. Documents are dealt into chunks of about
CHUNK_INPUT bytes. A chunk sends its distinct words and bigrams (64-bit hashes) with their
counts to ranges of hashes, in one packed message a range; a range sums them over all
chunks and answers each message with the sums, in the message's order, and with its share of
the totals. There are as many ranges as keep each within about half a chunk's bytes of input,
so neither a chunk nor a range grows with the corpus; the messages, chunks times ranges, do.
Beyond LARGE bytes of input chunks grow with its root, to BIGGEST bytes, to keep messages few. A chunk that has all answers scores its documents. A frequent word is one entry a
chunk, so no key is hot, and nothing is gathered on the driver or broadcast.

Cases: null and empty texts have no tokens and null losses; without target documents the
target model is uniform; repeated rows count each time they occur and all get a score; words
that were not counted have the uniform share only; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Weight of a context's own bigrams is count / (count + PRIOR); UNIFORM is shared out evenly.
PRIOR, UNIFORM = 20.0, 0.05
#: Bytes of input tables in a chunk of documents; of input where chunks begin to grow, and of the largest chunk.
CHUNK_INPUT, LARGE, BIGGEST = 4 << 20, 64 << 30, 64 << 20

_START, _WORD, _ODD = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95), np.uint64(1)
#: Bytes of a count in a message and in an answer.
_SENT, _ANSWERED = 4, 5


def _tokens(table: pa.Table):
    """First word of each text (one more at the end) and word hashes, over all rows."""
    data, at = common.text_bytes(table["text"])
    firsts, hashes, n = [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)], 0
    for a, b in common.chunks(at):
        _, _, first, h = common.word_hashes(data, at[a : b + 1])
        firsts.append(first[1:] + n)
        hashes.append(h)
        n += len(h)
    return np.concatenate(firsts), np.concatenate(hashes)


def _keys(first: np.ndarray, h: np.ndarray):
    """Sorted distinct keys; for every token the place of its word and of its bigram; the start's place.

    Odd keys are words, even ones bigrams and the start of a text.
    """
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][np.diff(first) > 0]] = _START
    pair = common.mix(common.mix(before + _WORD) * np.uint64(0x9E3779B97F4A7C15) + h) & ~_ODD
    start = np.array([_START & ~_ODD])
    keys, place = np.unique(np.concatenate([common.mix(h ^ _WORD) | _ODD, pair, start]), return_inverse=True)
    return keys, place[: len(h)], place[len(h) : 2 * len(h)], place[-1]


def _pack(values: np.ndarray, width: int) -> bytes:
    """Low ``width`` bytes of 64-bit values, as planes that compress."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(*values.shape, 8)[..., :width].swapaxes(-1, -2).tobytes()


def _unpack(data, rows: int, width: int) -> np.ndarray:
    """(rows, n) values that ``_pack`` packed."""
    planes = np.frombuffer(data, np.uint8).reshape(rows, width, -1)
    out = np.zeros((rows, planes.shape[2], 8), np.uint8)
    out[..., :width] = planes.swapaxes(-1, -2)
    return out.view("<u8")[..., 0]


def _send(table: pa.Table, bits: int) -> pa.Table:
    """A chunk's messages, one for each of 2**bits ranges: keys, then n, n of the target, and how many of each end a text."""
    first, h = _tokens(table)
    keys, word, pair, start = _keys(first, h)
    length = np.diff(first)
    some = length > 0
    last = word[first[1:][some] - 1]
    counts = np.zeros((4, len(keys)), np.int64)
    counted = table["counted"].to_numpy(zero_copy_only=False).astype(bool)
    labelled = pc.is_in(table["doc_id"], table["doc_id"].filter(table["is_label"]).combine_chunks())
    target = pc.or_(table["is_target"], labelled).to_numpy(zero_copy_only=False).astype(bool)
    for k, rows in enumerate((counted, counted & target)):
        on = np.repeat(rows, length)
        counts[k] = np.bincount(word[on], minlength=len(keys)) + np.bincount(pair[on], minlength=len(keys))
        counts[k, start] = np.count_nonzero(rows & some)
        counts[k + 2] = np.bincount(last[rows[some]], minlength=len(keys))
    ranges = 1 << bits
    edge = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(ranges + 1, dtype=np.uint64))
    data = [_pack(np.diff(keys[a:b], prepend=np.uint64(0)), 8) + _pack(counts[:, a:b], _SENT) for a, b in zip(edge, edge[1:])]
    chunk = np.full(ranges, table["chunk"][0].as_py(), np.int64)
    return pa.table({"bucket": pa.array(np.arange(ranges, dtype=np.int32)), "chunk": chunk, "data": pa.array(data, pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """A range's answers: for each message the sums of its keys, and the range's words, tokens and target tokens."""
    keys, counts = [], []
    for data in table["data"]:
        data = data.as_buffer()
        cut = data.size * 8 // (8 + 4 * _SENT)
        keys.append(np.cumsum(_unpack(data[:cut], 1, 8)[0], dtype=np.uint64))
        counts.append(_unpack(data[cut:], 4, _SENT))
    edge = np.cumsum([0] + [len(k) for k in keys])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate(counts, 1)
    sums = np.stack([np.bincount(place, c, len(distinct)).astype(np.int64) for c in counts])
    words = sums[:, (distinct & _ODD).astype(bool)]
    data = [_pack(sums[:, place[a:b]], _ANSWERED) for a, b in zip(edge, edge[1:])]
    own = [np.full(len(data), v, np.int64) for v in (np.count_nonzero(words[0]), words[0].sum(), words[1].sum())]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "data": pa.array(data, pa.binary()), "words": own[0], "tokens": own[1], "target": own[2]})


def _score(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of a chunk's asked documents."""
    first, h = _tokens(table)
    keys, word, pair, start = _keys(first, h)
    answers = answers.sort_by("bucket")
    counts = np.concatenate([_unpack(d.as_buffer(), 4, _ANSWERED) for d in answers["data"]], 1).astype(float)
    size = answers["words"].to_numpy().sum() + 1
    totals = [answers[name].to_numpy().sum() for name in ("tokens", "target")]
    scales = (totals[1] / totals[0] if all(totals) else 1.0, 1.0)
    n = np.diff(first)
    some = np.flatnonzero(n)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first[:-1][some]] = start
    mean = np.zeros((2, len(n)))
    for k, (total, scale) in enumerate(zip(totals, scales)):
        seen = (counts[k] - counts[k + 2])[context] * scale
        share = counts[k][pair] * scale / np.maximum(seen, 1e-9)
        weight = seen / (seen + PRIOR)
        single = (1 - UNIFORM) * counts[k][word] / max(total, 1) + (UNIFORM if total else 1.0) / size
        loss = -np.log(weight * share + (1 - weight) * single)
        if len(some):
            mean[k, some] = np.add.reduceat(loss, first[:-1][some]) / n[some]
    columns = [pa.array(c, mask=n == 0) for c in (mean[1], mean[0], mean[1] - mean[0])]
    out = pa.table([table["doc_id"], pa.array(n), *columns], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])
    return out.filter(table["asked"])


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """Number of chunks and bits of the number of ranges, by the size of the tables that ``docs`` reads;
    where Spark does not know it, by shuffle partitions."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 50:
        size = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2 * CHUNK_INPUT
    chunk = min(BIGGEST, max(CHUNK_INPUT, int(CHUNK_INPUT * (size / LARGE) ** 0.5)))
    return max(8, size // chunk), max(6, (2 * size // chunk).bit_length())


def _scores(rows: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """Scores of the asked ones of ``rows`` (doc_id, text, is_target, is_label, counted, asked) by models of the counted ones."""
    common.arrow_batches(rows.sparkSession)
    chunks, bits = sizes
    deal = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(chunks))
    rows = rows.withColumn("chunk", deal)

    def send(table: pa.Table) -> pa.Table:
        return _send(table, bits)

    messages = rows.groupBy("chunk").applyInArrow(send, "bucket int, chunk long, data binary")
    answers = messages.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, data binary, words long, tokens long, target long")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def _rows(docs: DataFrame, target, counted: bool, asked: bool) -> DataFrame:
    label = F.col("is_label") if "is_label" in docs.columns else F.lit(False)
    kept = [F.coalesce(target, F.lit(False)).alias("is_target"), label.alias("is_label"), F.lit(counted).alias("counted"), (F.lit(asked) & ~label).alias("asked")]
    return docs.select(F.col("doc_id").cast("long"), "text", *kept)


class Models:
    """Models of the documents ``docs`` (columns text and is_target); counted when they are used."""

    def __init__(self, docs: DataFrame):
        self.docs = docs


def fit(docs: DataFrame) -> Models:
    """Models from columns text and is_target; with a column is_label, its rows make targets of all rows of their doc_id."""
    return Models(docs)


def score(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_tokens, loss_target and loss_background (means over tokens) and score of every row."""
    known = models.docs if "doc_id" in models.docs.columns else models.docs.withColumn("doc_id", F.xxhash64("text"))
    rows = _rows(known, F.col("is_target"), True, False).union(_rows(docs, F.lit(False), False, True))
    return _scores(rows, max(_sizes(docs), _sizes(known)))


def score_all(docs: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """``score`` of the rows of ``docs`` (doc_id, text, is_target) by the models of these rows."""
    return _scores(_rows(docs, F.col("is_target"), True, True), sizes)


def labelled_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), and a row with is_label for each id that is labelled good and not toxic.

    Documents meet the label rows of their ids in their chunk, so texts are not moved for a join.
    """
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.lit(False).alias("is_target"), F.lit(False).alias("is_label"))
    return rows.union(good.select("doc_id", F.lit(None).cast("string"), F.lit(True), F.lit(True)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_all(labelled_target(docs, common.table(spark, sf_dir, "labels")), _sizes(docs))
