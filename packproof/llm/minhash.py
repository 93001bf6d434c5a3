"""Near-duplicate documents by DartMinHash.

A document is the weighted set of its runs of five words, each weighing its count (or one,
if not ``weighted``). A weight is as many regions of unit width, numbered by repetition, in
which darts land at hashed ranks, by a Poisson process that depends on the region only. A document sees the darts of its
regions up to a rank that lets it expect K ln K + 2K of them; every dart belongs to one
of K coordinates, and a coordinate keeps its earliest dart. Two documents agree in a
coordinate with probability equal to their weighted Jaccard similarity, the sum of lesser
weights over the sum of greater ones. Coordinates
without a dart are filled by looking twice as far.

Documents whose weighted sets are equal collapse to one numbered representative, first within
a chunk, then by a map-side aggregate. Representatives that agree in a band of four
coordinates share a bucket, unless too few of their elements are in any other document of
a bucket for a partner to exist. A bucket never emits all its pairs: members are compared with
one pivot, and only buckets that then still hold several components go on, with other
pivots, until every pair is either in one component or compared. Each pair is verified by
the weighted Jaccard similarity of its sets (64-bit hashes of their regions), at least THRESHOLD.

At similarity 0.8, 20 bands of 4 miss a pair with probability (1 - 0.8^4)^20 < 3e-5.

Cases: a document of one to four words has one element, all its words; null and empty
texts and rows with null ``doc_id`` have no element and a class of their own; repeated
rows get the same class, and ``keep_one`` keeps one of them; a ``doc_id`` with several texts
links whatever its texts link; ties go to the smaller ``doc_id``; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
#: One bucket in so many is settled before the others.
FIRST = 5
#: Edges that a task contracts at a time.
EDGES = 1 << 18
#: Rounds in which sets without a possible partner are dropped before pairs are formed.
PRUNINGS = 2
#: Rank cells double from FINE to 1 and have unit length from there.
FINE = 1 / 64
_CELLS = [0.0, *(FINE * 2**k for k in range(7))]
_U = np.uint64


def elements(first: np.ndarray, h: np.ndarray, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(document, element) sorted and distinct; of word hashes ``h`` with first words ``first``."""
    sizes = np.diff(first)
    at = np.arange(len(h))
    run = np.zeros(len(h), np.uint64)
    run[: max(0, len(h) - SHINGLE + 1)] = common.runs(h, SHINGLE, 5)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.repeat(first[1:], sizes) - at >= SHINGLE
    doc, run = doc[whole], run[whole]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        place = at - np.repeat(first[:-1], sizes)
        mixed = common.mix(h + (place + 1).astype(np.uint64) * _U(0xA24BAED4963EE407))
        few = np.isin(np.repeat(np.arange(len(sizes)), sizes), short)
        total = np.zeros(len(sizes), np.uint64)
        np.add.at(total, np.repeat(np.arange(len(sizes)), sizes)[few], mixed[few])
        doc, run = np.concatenate([doc, short]), np.concatenate([run, common.mix(total[short] + _U(1))])
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])
    if not weighted:
        return doc[new], run[new]
    start = np.flatnonzero(new)
    repetition = np.arange(len(doc)) - start[np.cumsum(new) - 1] if len(doc) else np.zeros(0, np.int64)
    run = np.where(repetition > 0, common.mix(run + repetition.astype(np.uint64) * _U(0x9FB21C651E98DF25)), run)
    order = np.lexsort((run, doc))
    return doc[order], run[order]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def _poisson(u: np.ndarray, area: float) -> np.ndarray:
    n = np.zeros(len(u), np.int64)
    term = np.exp(-area)
    below, k = term, 0
    over = np.flatnonzero(u >= below)
    while len(over) and k < 40:
        n[over] += 1
        k += 1
        term *= area / k
        below += term
        over = over[u[over] >= below]
    return n


def _throw(doc: np.ndarray, unit: np.ndarray, cell: np.ndarray, low: np.ndarray | float, width: float, reach: np.ndarray, best: np.ndarray) -> None:
    """Darts of the given cells of units; the earliest of each document and coordinate go to ``best``."""
    seed = common.mix(unit + (cell + 1).astype(np.uint64) * _U(0xD1342543DE82EF95))
    n = _poisson(_unit(seed), width)
    hit = np.flatnonzero(n)
    n = n[hit]
    which = np.repeat(hit, n)
    number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    dart = common.mix(seed[which] + (number + 1).astype(np.uint64) * _U(0xAF251AF3B0F025B5))
    rank = (low[which] if isinstance(low, np.ndarray) else low) + width * _unit(dart)
    own = common.mix(dart + _U(0x2545F4914F6CDD1D))
    d = doc[which]
    ok = rank <= reach[d]
    value = (rank[ok].astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | (own[ok] >> _U(32))
    np.minimum.at(best, d[ok] * K + ((own[ok] & _U(0xFFFFFFFF)) % _U(K)).astype(np.int64), value)


def sketch(doc: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """(n, K) earliest darts of documents 0..n-1; documents without units keep the largest value."""
    sizes = np.bincount(doc, minlength=n)
    out = np.full((n, K), ~_U(0))
    darts = K * np.log(K) + 2 * K
    todo = np.flatnonzero(sizes)
    far = 1.0
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        mine = place[doc] >= 0
        d, u = place[doc[mine]], unit[mine]
        reach = far * darts / sizes[todo]
        best = np.full(len(todo) * K, ~_U(0))
        for c, (low, high) in enumerate(zip(_CELLS[:-1], _CELLS[1:])):
            on = reach[d] > low
            _throw(d[on], u[on], np.full(int(on.sum()), c), low, high - low, reach, best)
        more = np.maximum(np.ceil(reach - 1), 0).astype(np.int64)[d]
        which = np.repeat(np.arange(len(d)), more)
        step = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more)
        _throw(d[which], u[which], step + len(_CELLS), 1.0 + step, 1.0, reach, best)
        best = best.reshape(-1, K)
        full = (best != ~_U(0)).all(1)
        out[todo[full]] = best[full]
        todo = todo[~full]
        far *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; the band's number is part of the key."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _U(0x8CB92BA72F3D8DD7)
    for r in range(ROWS):
        key = common.mix(key + parts[:, :, r] * _U(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def _set_ids(doc: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B):
        total = np.zeros(n, np.uint64)
        np.add.at(total, doc, common.mix(unit ^ _U(salt)))
        out.append(total.view(np.int64))
    return out[0], out[1]


def sketches(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, version (hash of the text), high, low (the set's identity) and bands; within a chunk only a set's first row has bands."""

    def run(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(2))
            for a, b in common.chunks(at):
                _, _, first, h = common.word_hashes(data, at[a : b + 1])
                doc, unit = elements(first, h, weighted)
                high, low = _set_ids(doc, unit, b - a)
                some = np.flatnonzero(np.diff(first) > 0)
                if not len(some):
                    continue
                _, lead = np.unique(np.stack([high[some], low[some]]), axis=1, return_index=True)
                lead = some[lead]
                place = np.full(b - a, -1)
                place[lead] = np.arange(len(lead))
                mine = place[doc] >= 0
                keys = band_keys(sketch(place[doc[mine]], unit[mine], len(lead)))
                sizes = np.zeros(b - a, np.int64)
                sizes[lead] = BANDS
                order = np.argsort(lead)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)), pa.array(keys[order].ravel()))
                own = (batch.column(k).slice(a, b - a).take(pa.array(some)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*own, pa.array(high[some]), pa.array(low[some]), bands], ["doc_id", "version", "high", "low", "bands"])

    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
    return rows.mapInArrow(run, "doc_id long, version long, high long, low long, bands array<long>")


def element_sets(docs: DataFrame, sets: DataFrame, weighted: bool = True) -> DataFrame:
    """node and its regions (array<long>) of the ``sets`` (node, rep, high, low), from the text of each one's ``rep``."""

    def run(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(3))
            high, low = (batch.column(k).to_numpy() for k in (1, 2))
            for a, b in common.chunks(at):
                _, _, first, h = common.word_hashes(data, at[a : b + 1])
                doc, unit = elements(first, h, weighted)
                own_high, own_low = _set_ids(doc, unit, b - a)
                edges = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(unit.view(np.int64)))
                same = pa.array(np.flatnonzero((own_high == high[a:b]) & (own_low == low[a:b])))  # not another text of that doc_id
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(same), lists.take(same)], ["node", "units"])

    plain = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep is not null and text is not null")
    return plain.join(sets, "rep").select("node", "high", "low", "text").mapInArrow(run, "node long, units array<long>").dropDuplicates(["node"])


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with j, the Jaccard similarity of their sets."""
    left = sets.select(F.col("node").alias("a"), F.col("units").alias("ua"))
    right = sets.select(F.col("node").alias("b"), F.col("units").alias("ub"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("ua").alias("na"), F.size("ub").alias("nb"), F.size(F.array_intersect("ua", "ub")).alias("both"))
    return joined.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("j"))


def met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with j, ``inside`` (elements of b that a has) and ``mask``, those elements as bits."""
    left = sets.select(F.col("node").alias("a"), F.col("units").alias("ua"))
    right = sets.select(F.col("node").alias("b"), F.col("units").alias("ub"))

    def run(batches):
        for batch in batches:
            inside, j, masks = [], [], []
            (a_edges, a_units), (b_edges, b_units) = ((np.asarray(c.offsets), c.values.to_numpy()) for c in (batch.column(2), batch.column(3)))
            for k in range(len(batch)):
                a, b = a_units[a_edges[k] : a_edges[k + 1]], b_units[b_edges[k] : b_edges[k + 1]]
                has = np.isin(b, a)
                inside.append(int(has.sum()))
                j.append(inside[-1] / (len(a) + len(b) - inside[-1]))
                bits = np.packbits(np.append(has, np.zeros(-len(has) % 64, bool)))
                masks.append(bits.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j, pa.float64()), pa.array(inside, pa.int64()), pa.array(masks, pa.list_(pa.int64()))], ["a", "b", "j", "inside", "mask"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub")
    return joined.mapInArrow(run, "a long, b long, j double, inside long, mask array<long>")


def partnered(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, n (regions) and m (of them in another set) of the sets that may have a partner: m >= threshold * n.

    Nothing is lost, as a set shares that many elements with any partner. Documents that
    agree in a passage only, however many they are, go before any pair is formed.
    """
    flat = sets.select("node", F.size("units").alias("n"), F.explode("units").alias("unit"))
    shared = flat.groupBy("unit").agg(F.count("*").alias("m")).filter("m > 1").select("unit")
    found = flat.join(shared, "unit", "left_semi").groupBy("node", "n").agg(F.count("*").alias("m"))
    return found.filter(F.col("m") >= threshold * F.col("n") - 1e-6).select("node", "n", "m")


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with b < a that join the same nodes as ``edges`` do: within each chunk of EDGES edges, every node and the smallest that it reaches."""

    def run(batches):
        for a, b in _gathered(batches):
            ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            x, y = place[: len(a)], place[len(a) :]
            label = np.arange(len(ids))
            while not np.array_equal(label[x], label[y]):
                least = np.minimum(label[x], label[y])
                np.minimum.at(label, label[x], least)
                np.minimum.at(label, label[y], least)
                while not np.array_equal(label, label[label]):
                    label = label[label]
            moved = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _gathered(batches):
    held, rows = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        rows += len(batch)
        if rows >= EDGES:
            yield [np.concatenate(c) for c in zip(*held)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node of its component, for every node of ``edges`` (a, b) that is not itself the smallest.

    Edges are first replaced by stars, within chunks and without a shuffle. Each round then
    moves every node to the smallest end of its edges, and only edges between nodes that moved
    to different ones are left, so the table of edges shrinks from round to round.
    """
    rest, labels = common.materialise(stars(edges), "stars"), None
    while True:
        step = common.materialise(rest.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")), "step")
        to = lambda end: step.select(F.col("node").alias(end), F.col("comp").alias(f"to_{end}"))
        moved = rest.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        rest = common.materialise(stars(moved.filter("a <> b")), "stars")
        if labels is not None:
            on = labels.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
            step = common.materialise(on.union(step.join(labels.select("node"), "node", "left_anti")), "labels")
        labels = step
        if rest.isEmpty():
            return labels


def link(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node and comp of the members (key, node, n, m) that have a verified link to a smaller node's component.

    In some of the buckets all members meet the pivot first: the member with the fewest
    elements of its own, which in a group of edited copies is nearest to all. That settles most
    groups, and a bucket within one component is done. In the others all members meet the
    pivot, and each keeps a bit mask of the pivot's elements that it has. Then, round by round,
    members meet the pivots of a growing number of hashed shares of the bucket (2**20 at most),
    but only those of another component that could be close: the masks give their common
    elements within the first pivot exactly, and the shared elements that each has outside of it
    bound the rest. Pivots leave their bucket, as they have met all others that matter. It ends
    when no bucket holds members that could still be linked.
    """
    shares = 1
    best = F.struct((F.col("m") / F.col("n")).alias("whole"), (-F.col("node")).alias("id"))

    def may_be_close(common_: Column, n: Column, other: Column) -> Column:
        return common_ * (1 + threshold) >= threshold * (n + other) - 1e-6

    def pivots_of(rows: DataFrame, *carried: str) -> DataFrame:
        share = F.pmod(F.xxhash64("node"), F.lit(shares)).alias("share")
        chosen = rows.groupBy("key", share).agg(F.max_by(F.struct("node", *carried), best).alias("p"))
        return chosen.select("key", F.col("p.node").alias("b"), *(F.col(f"p.{c}").alias(f"{c}_b") for c in carried))

    def close_to(pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.col("j") >= threshold - 1e-9).select("a", "b")

    first = common.materialise(members.join(pivots_of(members), "key").filter("node <> b"), "first")
    pairs = lambda rows: rows.select(F.col("node").alias("a"), "b").distinct()
    edges = common.materialise(close_to(measured(pairs(first.filter(F.pmod(F.xxhash64("key"), F.lit(FIRST)) == 0)), sets)), "links")
    comps = components(edges)
    named = members.join(comps, "node", "left").groupBy("key").agg(F.min(F.coalesce("comp", "node")).alias("x"), F.max(F.coalesce("comp", "node")).alias("y"))
    first = first.join(common.materialise(named.filter("x < y").select("key"), "open"), "key", "left_semi")
    found = common.materialise(met(pairs(first), sets), "met")
    comps = components(close_to(found).union(comps))
    left = first.withColumnRenamed("node", "a").join(found, ["a", "b"]).select("key", F.col("a").alias("node"), "n", "m", "inside", "mask")
    while True:
        now = left.join(comps, "node", "left").select("key", "node", "n", "m", "inside", "mask", F.coalesce("comp", "node").alias("comp"))
        now = common.materialise(now, "members")
        open_keys = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("n").alias("least")).filter("x < y").select("key", "least")
        rest = now.join(open_keys, "key").filter(may_be_close(F.col("m"), F.col("n"), F.col("least"))).drop("least")
        if rest.isEmpty():
            return comps
        shares = min(shares * 32, 1 << 20)
        pivots = common.materialise(pivots_of(rest, "comp", "n", "m", "inside", "mask"), "pivots")
        within = F.aggregate(F.zip_with("mask", "mask_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
        outside = F.least(F.col("m") - F.col("inside"), F.col("m_b") - F.col("inside_b"))
        able = may_be_close(F.least("m", "m_b"), F.col("n"), F.col("n_b")) & may_be_close(within + outside, F.col("n"), F.col("n_b"))
        own = rest.select(F.col("key").alias("own"), F.col("node").alias("a"), "comp", "n", "m", "inside", "mask")
        pairs = own.join(pivots, (F.col("own") == F.col("key")) & (F.col("comp") != F.col("comp_b")) & able)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        close = common.materialise(measured(pairs, sets).filter(F.col("j") >= threshold - 1e-9).select("a", "b"), "links")
        if not close.isEmpty():
            comps = components(close.union(comps))
        left = rest.drop("comp").join(pivots.select("key", F.col("b").alias("node")), ["key", "node"], "left_anti")


def classes(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """doc_id, version and class (a number) of every row that has words."""
    common.arrow_batches(docs.sparkSession)
    rows = common.materialise(sketches(docs, weighted), "sketches")
    reps = rows.groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.max("bands").alias("bands"))
    reps = common.materialise(reps.withColumn("node", F.monotonically_increasing_id()), "sets")
    exploded = reps.select("node", F.explode("bands").alias("key"))
    full = exploded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = common.materialise(exploded.join(full, "key", "left_semi").select("key", "node"), "members")
    some = reps.select("node", "rep", "high", "low").join(members.select("node").distinct(), "node", "left_semi")
    sets = common.materialise(element_sets(docs, some, weighted), "element-sets")
    for _ in range(PRUNINGS):
        some = common.materialise(partnered(sets, threshold), "partnered")
        sets = common.materialise(sets.join(some, "node", "left_semi"), "element-sets")
    members = members.join(some, "node").select("key", "node", "n", "m")
    full = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    comps = link(common.materialise(members.join(full, "key", "left_semi"), "members"), sets, threshold)
    named = reps.join(comps, "node", "left").select("high", "low", F.coalesce("comp", "node").alias("class"))
    return rows.select("doc_id", "version", "high", "low").join(named, ["high", "low"]).select("doc_id", "version", "class")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class, of every row of ``docs``; documents without words are a class of their own."""
    found = common.materialise(classes(docs, threshold, weighted), "classes")
    twice = found.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b")
    if not twice.isEmpty():  # a doc_id with several texts is one document: its classes are linked
        rows = found.join(twice.select("doc_id", "a"), "doc_id")
        joined = components(rows.filter("a < class").select("a", F.col("class").alias("b"))).withColumnRenamed("node", "class")
        found = found.join(joined, "class", "left").select("doc_id", F.coalesce("comp", "class").alias("class"))
    least = found.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    found = found.select("doc_id", "class").distinct().join(least, "class").select("doc_id", "class_id")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return every.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """One row of each class of ``docs``: the smallest ``doc_id``, and one of rows that repeat its text. Rows without words stay."""
    found = common.materialise(classes(docs, threshold, weighted), "classes")
    first = found.groupBy("class").agg(F.min(F.struct("doc_id", "version")).alias("first"))
    counted = found.groupBy("doc_id", "version", "class").agg(F.count("*").alias("copies"))
    rest = counted.join(first, "class").select(F.col("doc_id").alias("__id"), F.col("version").alias("__v"), "copies", (F.struct("doc_id", "version") == F.col("first")).alias("is_first"))
    # most documents are the first of their class and occur once: only the others meet the texts
    rest = common.materialise(rest.filter("not is_first or copies > 1"), "others")
    same = (docs["doc_id"].cast("long") == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__v"))
    alone = docs.join(rest, same, "left_anti")
    repeated = rest.filter("is_first")
    if repeated.isEmpty():
        return alone
    one = docs.join(repeated.select("__id", "__v"), same).dropDuplicates(["__id", "__v"]).select(*docs.columns)
    return alone.unionByName(one)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).withColumn("is_kept", F.col("doc_id") == F.col("class_id"))
