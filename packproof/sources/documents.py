"""Large JSON documents in pieces: the elements of a document's arrays, read by many tasks (SRC-1, SRC-2).

A file is cut at every comma, which the text reader does for any range of a file. What a cut
lies in follows from what is before it: the number of quotes says whether it is inside a
string, the brackets outside strings how deep it lies, the commas at an array's depth which
element it belongs to. A first pass sums these up by the file's splits, for a split that
begins outside a string and for one that begins inside; running sums over the splits, one row
each, give what each of them begins in. With it a task reads its split from start to end and
sends nothing: only elements that a batch of cuts does not hold whole are put together by a
shuffle. A comma is never part of an escape, so no cut separates a backslash from what it escapes.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import fresh_path

_SUMS = "file string, block long, quotes long, list boolean, change array<long>, starts array<map<int,long>>"
_PARTS = "file string, keys long, element long, list boolean, block long, id long, after long, starts_key boolean, whole boolean, text binary"


def _flat(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all values, one after another, and where each begins and the last one ends."""
    large = column.cast(pa.large_binary())
    at = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    data = large.buffers()[2]
    return (data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data else b""), at - at[0]


def _depths(data: bytes, at: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Of cuts that follow each other: which begin outside strings, the depth before each and after the last, and the number of quotes."""
    if b"\\" in data:
        data = re.sub(rb"(?s)\\.", b"__", data)
    signs = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(signs == ord('"'))
    seen = np.searchsorted(quotes, at)
    brackets = np.flatnonzero(np.isin(signs, np.frombuffer(b"[]{}", np.uint8)))
    brackets = brackets[(np.searchsorted(quotes, brackets) + inside) % 2 == 0]
    step = np.where(np.isin(signs[brackets], np.frombuffer(b"[{", np.uint8)), 1, -1)
    depth = np.concatenate([[0], np.cumsum(step)])[np.searchsorted(brackets, at)]
    return (seen[:-1] + inside) % 2 == 0, depth, len(quotes)


def _stretches(batch: pa.RecordBatch):
    """(file, block, first, last + 1) of the rows of one split that follow each other."""
    names, blocks = batch.column(0), batch.column(1)
    if not len(names):
        return
    new = pc.or_(pc.not_equal(names[1:], names[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
    edges = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist()]
    for a, b in zip(edges, [*edges[1:], len(names)]):
        yield names[a].as_py(), blocks[a].as_py(), a, b


def _summed(batches):
    """One row a split: its quotes and, for a start outside and inside strings, its change of depth and its cuts outside strings by depth."""

    def row():
        return pa.RecordBatch.from_arrays([pa.array([split[0]], pa.string()), pa.array([split[1]], pa.int64()), pa.array([quotes], pa.int64()), pa.array([listed]), pa.array([change], pa.list_(pa.int64())), pa.array([[list(c.items()) for c in starts]], pa.list_(pa.map_(pa.int32(), pa.int64())))], ["file", "block", "quotes", "list", "change", "starts"])

    split = None
    for batch in batches:
        for file, block, a, b in _stretches(batch):
            data, at = _flat(batch.column(3).slice(a, b - a))
            if split != (file, block):
                if split:
                    yield row()
                split, quotes, change, starts = (file, block), 0, [0, 0], [Counter(), Counter()]
                listed = block == 0 and data[: at[1]].lstrip().startswith(b"[")
            before = quotes
            for inside in (0, 1):
                outside, depth, n = _depths(data, at, (before + inside) % 2 == 1)
                found, times = np.unique(depth[:-1][outside] + change[inside], return_counts=True)
                starts[inside].update(dict(zip(found.tolist(), times.tolist())))
                change[inside] += int(depth[-1])
            quotes = before + n
    if split:
        yield row()


def _elements(partial: bool):
    """A task's elements; ``partial`` asks for parts of elements and for those that begin a key instead of whole ones."""

    def run(batches):
        split = None
        for batch in batches:
            out = []
            for file, block, a, b in _stretches(batch):
                values = batch.column(3).slice(a, b - a)
                first = batch.column(2)[a].as_py()
                if split != (file, block):
                    split = (file, block)
                    inside, level, start, keys, element = (batch.column(k)[a].as_py() for k in range(4, 9))
                    if level is None:
                        raise ValueError(f"the splits of {file} are not those that were summed up: read it with the same settings")
                outside, depth, n = _depths(*_flat(values), inside)
                values = values.to_pylist()
                depth = depth + start
                begins, names = outside & (depth[:-1] <= level), outside & (depth[:-1] < level)
                every, key = element + np.cumsum(begins), keys + np.cumsum(names)
                edges = np.flatnonzero(begins).tolist()
                if not edges or edges[0]:
                    edges.insert(0, 0)
                for k, (x, y) in enumerate(zip(edges, [*edges[1:], len(values)])):
                    whole = bool(begins[x]) and k + 1 < len(edges)
                    if partial and (not whole or names[x]) or not partial and whole:
                        out.append((file, int(key[x]), int(every[x]), level == 1, block, first + x, int(depth[y]), bool(names[x]), whole, b",".join(values[x:y])))
                inside, start, keys, element = (inside + n) % 2 == 1, int(depth[-1]), int(key[-1]), int(every[-1])
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in _PARTS.split(", ")])

    return run


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """A small table, written so that its size is known to plans over it."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _starts(cuts: DataFrame) -> DataFrame:
    """What each split begins in: file, block, inside, level of the array elements, depth, keys and elements before."""
    sums = _kept(cuts.mapInArrow(_summed, _SUMS), "splits")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    own = sums.withColumns({"inside": (before("quotes") % 2).cast("int"), "level": F.when(F.max("list").over(Window.partitionBy("file")), 1).otherwise(2)})
    own = own.select("file", "block", "inside", "level", F.get("change", F.col("inside")).alias("change"), F.get("starts", F.col("inside")).alias("starts")).withColumn("depth", before("change"))
    at = lambda k: F.coalesce(F.try_element_at("starts", (F.lit(k) - F.col("depth")).cast("int")), F.lit(0))
    own = own.withColumn("n_keys", at(0) + F.when(F.col("level") == 2, at(1)).otherwise(0))
    own = own.withColumn("n_elements", at(0) + at(1) + F.when(F.col("level") == 2, at(2)).otherwise(0))
    return own.select("file", "block", (F.col("inside") == 1).alias("inside"), "level", "depth", before("n_keys").alias("keys"), before("n_elements").alias("elements"))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``key``, ``list_pos`` and JSON ``text`` of the elements of every array that is a field of a file's top-level object.

    ``key`` is '' for the elements of a top-level array. Other fields of the object are left
    out. A file holds one document; it is expected to be valid JSON.
    """
    raw = spark.read.option("lineSep", ",").text(path)
    cuts = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "^\ufeff", "").cast("binary").alias("value"))
    # one row a split; a broadcast keeps the order of the cuts
    placed = cuts.join(F.broadcast(_kept(_starts(cuts), "starts")), ["file", "block"], "left").select(*cuts.columns, "inside", "level", "depth", "keys", "elements")
    few = _kept(placed.mapInArrow(_elements(True), _PARTS).withColumn("text", F.col("text").cast("string")), "parts")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "text"))), lambda p: p["text"]), ",")
    columns = ["file", "keys", "element", "list", "text", "after", "starts_key"]
    joined = few.filter("not whole").groupBy("file", "keys", "element", "list").agg(text.alias("text"), F.max_by("after", F.struct("block", "id")).alias("after"), F.max("starts_key").alias("starts_key")).select(*columns)
    # a key's first element comes with the key and the bracket, its last one with the brackets that follow
    head = F.when(F.col("list"), r"^\s*\[").otherwise(r'^\s*\{?\s*"((?:[^"\\]|\\.)*)"\s*:\s*\[')
    key = F.when(F.col("list"), "").otherwise(F.call_function("regexp_extract", F.col("text"), F.col("head"), F.lit(1)))
    named = joined.unionByName(few.filter("whole").select(*columns)).filter("starts_key").withColumn("head", head).filter(F.regexp_like("text", F.col("head")))
    keys = _kept(named.select("file", "keys", key.alias("key"), F.col("element").alias("from")), "keys")
    made = placed.mapInArrow(_elements(False), _PARTS).withColumn("text", F.col("text").cast("string")).select(*columns).unionByName(joined)
    surplus = F.when(F.col("list"), 1).otherwise(2) - F.col("after")
    made = made.withColumns({"head": head, "whole": F.when(surplus == 1, F.regexp_replace("text", r"\s*\]\s*$", "")).when(surplus == 2, F.regexp_replace("text", r"\s*\]\s*\}\s*$", "")).otherwise(F.col("text"))})
    own = F.trim(F.when(F.col("starts_key"), F.regexp_replace("whole", F.col("head"), F.lit(""))).otherwise(F.col("whole")))
    found = made.select("file", "keys", "element", own.alias("text")).join(keys, ["file", "keys"])
    return found.filter("text <> ''").select("file", "key", (F.col("element") - F.col("from")).cast("int").alias("list_pos"), "text")


def array_table(elements: DataFrame, key: str, schema) -> DataFrame:
    """The elements of one array as rows: ``list_pos`` and the fields of ``schema``."""
    return elements.filter(F.col("key") == key).select("list_pos", F.from_json("text", schema).alias("row")).select("list_pos", "row.*")
