"""Media columns: content-addressed payloads in tar shards.

Every text becomes a grey 8-bit PNG, SIDE samples a row; its SHA-256 is its address. Tasks
append the images they have not stored yet to a tar shard of their own in the shared
folder. Rows carry digest, shard, offset and length; metadata columns come from range
reads of the first bytes of a member, and payloads are read back by range as well.

A shard is written under a name of its own and referenced only by rows of the task that
finished, so retried or repeated tasks do no harm. The same image may stand in the shards
of several tasks, at most once in each; the smallest place is the one that is read. This
keeps copies of a hot text out of every shuffle.

Cases: null reads as empty, whose payload is one row of bytes 255; equal texts have equal
values; repeated rows stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIDE = 576
#: Bytes that hold a PNG's signature and header chunk.
HEADER = 33
MANIFEST = "doc_id long, digest binary, shard string, offset long, length long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(text: bytes) -> bytes:
    """The text's bytes, filled with 255 up to whole rows, as a grey image."""
    payload = text + b"\xff" * (-len(text) % SIDE if text else SIDE)
    rows = np.zeros((len(payload) // SIDE, SIDE + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(image: bytes) -> bytes:
    """Samples of an image that ``to_png`` has written."""
    width, height, _ = read_header(image)
    at, data = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, then the counts of sixteen ranges of sample values."""
    counts = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return f"{len(payload) // SIDE}:" + ",".join(map(str, counts.tolist()))


def _file(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    """``file:/x`` as ``file:///x``."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write images of all texts to tar shards in ``folder``; the manifest, one row per document."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    folder = _uri(folder)

    def run(batches):
        system, place = _file(folder)
        system.create_dir(place, recursive=True)
        shard = f"shard-{uuid.uuid4().hex}.tar"
        out, at, seen = None, 0, {}
        for batch in batches:
            data, edges = common.text_bytes(batch.column(1))
            rows = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                image = to_png(data[a:b].tobytes())
                digest = hashlib.sha256(image).digest()
                if digest not in seen:
                    if out is None:
                        out = system.open_output_stream(f"{place}/{shard}")
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(image)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + image + b"\0" * (-len(image) % 512))
                    seen[digest] = at + len(head), len(image)
                    at += len(head) + -(-len(image) // 512) * 512
                rows.append((digest, *seen[digest]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([shard] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                ["doc_id", "digest", "shard", "offset", "length"],
            )
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MANIFEST)
    return common.materialise(rows, "manifest")


def places(manifest: DataFrame) -> DataFrame:
    """One place per digest."""
    least = F.min(F.struct("shard", "offset", "length")).alias("p")
    return manifest.groupBy("digest").agg(least).select("digest", "p.*")


def _ranges(batches, folder: str, size):
    """Rows of each batch with the bytes at their place; ``size`` gives how many of a length."""
    system, base = _file(folder)
    name, file = None, None
    for batch in batches:
        images = []
        for shard, offset, length in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            if shard != name:
                if file is not None:
                    file.close()
                name, file = shard, system.open_input_file(f"{base}/{shard}")
            images.append(file.read_at(size(length), offset))
        yield batch, images
    if file is not None:
        file.close()


def _sequential(at: DataFrame) -> DataFrame:
    """Tasks that each read a stretch of places in order."""
    return at.select("digest", "shard", "offset", "length").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def metadata(at: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits: header-only range reads."""
    folder = _uri(folder)

    def run(batches):
        for batch, heads in _ranges(batches, folder, lambda n: min(n, HEADER)):
            found = [read_header(h) for h in heads]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], ["digest", "width", "height", "bits"])

    return _sequential(at).mapInArrow(run, "digest binary, width long, height long, bits long")


def features(at: DataFrame, folder: str) -> DataFrame:
    """Per digest: sizes and digests of payload and media, tail checksum, feature, from whole images."""
    folder = _uri(folder)

    def run(batches):
        for batch, images in _ranges(batches, folder, lambda n: n):
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), images):
                media = hashlib.sha256(image)
                if media.digest() != digest:
                    raise ValueError("stored bytes do not have their address")
                payload = from_png(image)
                # UTF-8 never has a byte 255, so the fill can be told from the text
                rows.append((digest, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), media.hexdigest(), feature(payload)))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], FIELDS)

    return _sequential(at).mapInArrow(run, "digest binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


FIELDS = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_path(spark, "media")
    manifest = store(common.table(spark, sf_dir, "documents"), folder)
    at = common.materialise(places(manifest), "places")
    read = features(at, folder).join(metadata(at, folder), "digest")
    return manifest.select("doc_id", "digest").join(read, "digest").select("doc_id", *FIELDS[1:], "width", "height", "bits")


def unpack(folder: str, shard: str) -> dict[str, bytes]:
    """Members of a shard, by the standard library's reader (for checks)."""
    system, place = _file(_uri(folder))
    with system.open_input_stream(f"{place}/{shard}") as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar}
