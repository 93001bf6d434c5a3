"""Approximate nearest neighbours by NN-descent and greedy graph search.

Vectors are cut to distinct ones first: copies share a node, which keeps the few smallest
ids that an answer can need. The graph starts from sorted stretches of random hyperplane
codes, within which all vectors are compared, so no stretch grows with the data. NN-descent
then joins, for every node, its neighbours and reverse neighbours with each other, but for
pairs that have both been in the lists before, and keeps each node's nearest; reverse lists of
popular nodes are dealt over several groups instead of being cut. Rounds go on until at most
CHANGED of the list entries are new. Queries walk
the graph greedily from their own node with a beam, until all of the beam is opened.
Nodes are numbered by their smallest id, so that ties go to it in lists, beams and answers.
Graph work uses half-precision unit vectors, whose products are summed without rounding, so
that a pair has one similarity wherever it is compared; the beam is scored again in double
precision on the original vectors. Starting orders and the beam grow with the logarithm of
the table beyond USUAL vectors.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, as
queries and as candidates, nor do rows with null ``vec_id`` and vectors of another length
than most (of lengths that are as frequent, the smaller one counts); a query among few vectors gets
all of them; ties go to the smaller ``vec_id``; a repeated ``vec_id`` counts once per distinct
vector; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Neighbours of a node; starting orders; vectors compared in one stretch.
DEGREE, TREES, STRETCH = 20, 12, 2048
#: For every doubling of the table beyond USUAL vectors: more starting orders, and a wider beam.
USUAL, MORE_TREES, MORE_BEAM = 1 << 16, 4, 32
#: Share of list entries that a last NN-descent round may have changed.
CHANGED = 0.001
#: Reverse neighbours that are joined in one group; beam, nodes opened in a step of a search.
GROUP, BEAM, OPENED = 48, 96, 40
LIST = "array<struct<far:float,node:long>>"


def _vectors(column: pa.Array) -> np.ndarray:
    """(n, d) of a fixed-width binary column of half floats."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float64) if rows else np.zeros((0, 1))


def nodes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (node: numbers in the order of their smallest ids, vec, unit) and members (node, vec_id): at most k + 1 of each."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [(i, r) for i, r in zip(ids, rows) if i is not None and r and None not in r and np.isfinite(r).all() and np.any(r)]
            kept: dict[bytes, list[int]] = {}
            for i, r in good:
                kept.setdefault((np.array(r, np.float64) + 0.0).tobytes(), []).append(i)
            out = [(key, i) for key, found in kept.items() for i in sorted(set(found))[: k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64())], ["vec", "vec_id"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec binary, vec_id long")

    def least(batches):
        # one row a batch and vector came in; a hot vector's rows are few by now
        for batch in batches:
            lists = [sorted(set(x))[: k + 1] for x in batch.column(1).to_pylist()]
            units = []
            for raw in batch.column(0).to_pylist():
                v = np.frombuffer(raw, np.float64)
                v = v / np.abs(v).max()
                units.append((v / np.sqrt(v @ v)).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64())), pa.array(units, pa.binary())], ["vec", "ids", "unit"])

    full = rows.groupBy("vec").agg(F.collect_set("vec_id").alias("ids")).mapInArrow(least, "vec binary, ids array<long>, unit binary")
    # an id with two vectors would name two nodes: number those apart, in order
    order = [F.col("ids")[0], F.col("vec")]
    full = full.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())
    full = common.materialise(full, "nodes")
    return full.select("node", "vec", "unit"), full.select("node", F.explode("ids").alias("vec_id"))


def nearest(lists: DataFrame, keep: int) -> DataFrame:
    """node and its ``keep`` nearest of several lists."""
    every = F.array_distinct(F.flatten(F.collect_list("near")))
    return lists.groupBy("node").agg(F.slice(F.array_sort(every), 1, keep).alias("near"))


def _lists(node: np.ndarray, other: np.ndarray, sim: np.ndarray, keep: int) -> pa.RecordBatch:
    """The nearest ``keep`` of each node among pairs that a task has found."""
    far = (-sim).astype(np.float32)
    order = np.lexsort((other, far, node))
    node, other, far = node[order], other[order], far[order]
    fresh = np.ones(len(node), bool)
    fresh[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
    node, other, far = node[fresh], other[fresh], far[fresh]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    ok = place < keep
    node, other, far = node[ok], other[ok], far[ok]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    entries = pa.StructArray.from_arrays([pa.array(far), pa.array(other)], ["far", "node"])
    return pa.RecordBatch.from_arrays([pa.array(node[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(node)).astype(np.int32)), entries)], ["node", "near"])


def start(units: DataFrame, degree: int, trees: int = TREES) -> DataFrame:
    """First neighbour lists: all pairs within sorted stretches, for several random orders."""

    def coded(batches):
        for batch in batches:
            x = _vectors(batch.column(1))
            for tree in range(trees):
                planes = np.random.default_rng(tree).normal(size=(x.shape[1], 17)).astype(np.float32)
                side = x @ planes
                code = ((side[:, :16] > 0) << np.arange(15, -1, -1)).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), tree, np.int32)), pa.array(code.astype(np.int32)), pa.array(side[:, 16].astype(np.float32))], ["node", "unit", "tree", "code", "side"])

    def flushed(ids: np.ndarray, x: np.ndarray):
        sim = (x @ x.T).astype(np.float32)
        np.fill_diagonal(sim, -2)
        top = min(degree, len(ids) - 1)
        best = np.argpartition(-sim, top - 1, axis=1)[:, :top]
        return _lists(np.repeat(ids, top), ids[best].ravel(), np.take_along_axis(sim, best, 1).ravel(), degree)

    def compared(batches):
        now, held, size = None, [], 0
        for batch in batches:
            ids, x, trees = batch.column(0).to_numpy(), _vectors(batch.column(1)), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1], True]) if len(trees) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if trees[a] != now:
                    if size > 1:
                        yield flushed(*map(np.concatenate, zip(*held)))
                    now, held, size = trees[a], [], 0
                while a < b:
                    room = min(b - a, STRETCH - size)
                    held.append((ids[a : a + room], x[a : a + room]))
                    a, size = a + room, size + room
                    if size == STRETCH:
                        yield flushed(*map(np.concatenate, zip(*held)))
                        held, size = [], 0
        if size > 1:
            yield flushed(*map(np.concatenate, zip(*held)))

    order = ["tree", "code", "side"]
    dealt = units.mapInArrow(coded, "node long, unit binary, tree int, code int, side float").repartitionByRange(*order).sortWithinPartitions(*order)
    return nearest(dealt.mapInArrow(compared, f"node long, near {LIST}"), degree)


def improve(graph: DataFrame, units: DataFrame, degree: int) -> DataFrame:
    """One round of NN-descent: node, near and ``fresh``, the nodes that came to the list in this round.

    The neighbours of each node, both ways, are compared with each other, if one of them is fresh.
    """
    edges = graph.select("node", F.explode("near.node").alias("other"), "fresh").select("node", "other", F.array_contains("fresh", F.col("other")).alias("new"))
    popular = edges.groupBy(F.col("other").alias("node")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = edges.join(popular, "node", "left").select("node", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("groups", F.lit(1)), F.lit(1)) - 1)).alias("deal"), "other", "new")
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "new").join(popular, "node").select("node", F.pmod(F.xxhash64("other"), F.col("groups")).cast("int").alias("deal"), "other", "new")
    worst = F.element_at("near", -1)["far"]
    heads = graph.select(F.col("node").alias("other"), F.when(F.size("near") >= degree, worst).otherwise(F.lit(2.0).cast("float")).alias("worst")).join(units.withColumnRenamed("node", "other"), "other")
    members = dealt.union(back).groupBy("node", "deal", "other").agg(F.max("new").alias("new"))
    grouped = members.join(heads, "other").groupBy("node", "deal").agg(F.collect_list(F.struct("other", "worst", "unit", "new")).alias("all"), F.max("new").alias("some"))

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            edges = np.asarray(lists.offsets)
            entries = lists.values
            ids, worst, x = entries.field(0).to_numpy(), entries.field(1).to_numpy(), _vectors(entries.field(2))
            new = entries.field(3).to_numpy(zero_copy_only=False)
            a_out, b_out, s_out = [], [], []
            for p, q in zip(edges[:-1].tolist(), edges[1:].tolist()):
                sim = (x[p:q] @ x[p:q].T).astype(np.float32)
                a, b = np.nonzero((-sim <= worst[p:q, None]) & (new[p:q, None] | new[p:q]))
                off = a != b
                a, b = a[off], b[off]
                a_out.append(ids[p + a]), b_out.append(ids[p + b]), s_out.append(sim[a, b])
            if a_out:
                yield _lists(np.concatenate(a_out), np.concatenate(b_out), np.concatenate(s_out), degree)

    better = grouped.filter("some").select("all").mapInArrow(run, f"node long, near {LIST}")
    after = nearest(graph.select("node", "near").union(better), degree)
    return after.join(graph.select("node", F.col("near.node").alias("old")), "node").select("node", "near", F.array_except("near.node", "old").alias("fresh"))


def build(units: DataFrame, degree: int = DEGREE, trees: int = TREES) -> DataFrame:
    """The neighbour graph: node, near (array of far = -cosine and node)."""
    graph = common.materialise(start(units, degree, trees).withColumn("fresh", F.col("near.node")), "graph")
    while True:
        graph = common.materialise(improve(graph, units, degree), "graph")
        new, entries = graph.agg(F.sum(F.size("fresh")), F.sum(F.size("near"))).first()
        if (new or 0) <= CHANGED * (entries or 0):
            return graph


def walk(graph: DataFrame, units: DataFrame, queries: DataFrame, width: int = BEAM) -> DataFrame:
    """query (a node), node: the beam when greedy steps from each query's own node have opened all of it.

    A step opens the nearest nodes of each beam, brings their neighbours' vectors to the
    query, and keeps the nearest of all.
    """
    far = units.select(F.col("node").alias("other"), "unit")
    adjacent = graph.select("node", F.explode("near.node").alias("other")).join(far, "other").groupBy("node").agg(F.collect_list(F.struct("other", "unit")).alias("next"))
    adjacent = common.materialise(adjacent, "adjacent")
    state = "query long, head binary, beam array<struct<far:double,node:long>>, opened array<long>"
    beams = queries.join(units, "node").select(F.col("node").alias("query"), F.col("unit").alias("head"), F.array(F.struct(F.lit(-2.0).alias("far"), "node")).alias("beam"), F.array().cast("array<long>").alias("opened"))

    def step(batches):
        for batch in batches:
            rows = []
            for query, head, beam, opened, go, found in zip(*(c.to_pylist() for c in batch.columns)):
                have = {b["node"]: b["far"] for b in beam}
                fresh = {f["other"]: f["unit"] for f in found or [] if f["other"] not in have}
                if fresh:
                    x = _vectors(pa.array(list(fresh.values()), pa.binary()))
                    sim = x @ np.frombuffer(head, np.float16).astype(np.float64)
                    have |= zip(fresh, (-sim).tolist())
                best = sorted((d, n) for n, d in have.items())[: width + 1]
                rows.append((query, head, [{"far": d, "node": n} for d, n in best], [*opened, *go]))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("far", pa.float64()), ("node", pa.int64())])), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["query", "head", "beam", "opened"])

    while True:
        go = F.slice(F.filter(F.col("beam.node"), lambda n: ~F.array_contains("opened", n)), 1, OPENED)
        turn = common.materialise(beams.withColumn("go", go), "beams")
        if turn.filter(F.size("go") > 0).isEmpty():
            return turn.select("query", F.explode("beam.node").alias("node"))
        found = turn.select("query", F.explode("go").alias("node")).join(adjacent, "node").groupBy("query").agg(F.flatten(F.collect_list("next")).alias("found"))
        beams = turn.join(found, "query", "left").select("query", "head", "beam", "opened", "go", "found").mapInArrow(step, state)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each ``queries.vec_id``, by cosine."""
    spark = vectors.sparkSession
    common.arrow_batches(spark)
    lengths = vectors.filter("vec_id is not null and embedding is not null").groupBy(F.size("embedding").alias("n")).count()
    usual = lengths.orderBy(F.desc("count"), "n").limit(1).first()
    vectors = vectors.filter(F.size("embedding") == (usual["n"] if usual else 0))
    full, members = nodes(vectors, k)
    units = full.select("node", "unit")
    doublings = max(0, units.count() - 1).bit_length() - (USUAL - 1).bit_length()
    doublings = max(0, doublings)
    graph = build(units, trees=TREES + MORE_TREES * doublings)
    asked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).join(queries.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi")

    def keyed(batches):
        for batch in batches:
            rows = [(i, (np.array(r, np.float64) + 0.0).tobytes()) for i, r in zip(*(c.to_pylist() for c in batch.columns)) if r and None not in r and np.isfinite(r).all() and np.any(r)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["query_id", "vec"])

    own = asked.mapInArrow(keyed, "query_id long, vec binary").join(full.select("vec", F.col("node").alias("query")), "vec")
    own = common.materialise(own.select("query_id", "query").distinct(), "queries")
    found = walk(graph, units, own.select(F.col("query").alias("node")).distinct(), BEAM + MORE_BEAM * doublings)

    def exact(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c), np.float64).reshape(len(c), -1) if len(c) else np.zeros((0, 1)) for c in (batch.column(k).to_pylist() for k in (2, 3)))
            score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query", "node", "score"])

    vec = full.select("node", "vec")
    pairs = found.join(vec, "node").join(vec.select(F.col("node").alias("query"), F.col("vec").alias("head")), "query").select("query", "node", "vec", "head")
    scored = pairs.mapInArrow(exact, "query long, node long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    scored = scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    rows = own.join(scored, "query").join(members, "node").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0).select("vec_id"))
