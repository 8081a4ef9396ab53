"""Media columns: content-addressed payloads in tar shards.

Every text's UTF-8 bytes, filled up with blanks to a positive multiple of
``WIDTH``, become the samples of an 8-bit greyscale PNG (filter 0, deflate),
which is lossless. A task writes its images into tar shards in the shared
folder, member name = SHA-256 of the stored form, each image once per shard;
rows carry digest, shard, offset and length. Metadata columns come from range
reads of the 33 header bytes; payloads are read back from the same ranges.

Defined results: null text is empty (one row of blanks); equal texts have
equal values; texts of any length are whole; an empty table gives no rows;
extra columns are ignored. A shard is written under a name of its attempt and
renamed when it is complete, so a repeated task leaves whole shards only.
release() of ``shared`` removes shards and index when they are no longer read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import base_columns, fresh_path, materialize, partitions
from .textkit import slices

WIDTH = 192
SHARD_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and IHDR chunk
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def padded(raw: bytes, width: int = WIDTH) -> bytes:
    return raw + b" " * (-len(raw) % width if raw else width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(image: bytes) -> bytes:
    """The samples, in order; every chunk's checksum is tested."""
    width, height, depth, colour = png_header(image[:HEADER])
    at, packed = 8, []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("checksum of a PNG chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if (depth, colour) != (8, 0):
        raise ValueError("8-bit greyscale only")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filter 0 only")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes, width: int, height: int) -> str:
    """Size, mean, variance in thousandths and a 64-bit average hash over an 8 x 8 grid; whole numbers only."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    across = x.reshape(height, 8, width // 8).sum(axis=2)
    edges = np.arange(8) * height // 8
    grid = np.add.reduceat(across, edges, axis=0)
    size = (np.diff(np.append(edges, height)).clip(1) * (width // 8))[:, None]
    bits = (grid * n > total * size).ravel()
    mark = int.from_bytes(np.packbits(bits).tobytes(), "big")
    return f"{width}x{height} mean={total * 1000 // n} var={(n * squares - total * total) * 1000 // (n * n)} ahash={mark:016x}"


def arrow_address(uri: str) -> str:
    """Arrow's form of an address as Hadoop writes it (file:/, s3a://, s3n://; hdfs://, gs:// and abfss:// are the same)."""
    scheme, colon, rest = uri.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    return f"file://{rest}" if scheme == "file" and not rest.startswith("//") else uri


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(arrow_address(uri))


class _Shards:
    """Writes images into tar shards of about SHARD_BYTES; equal images of a shard lie there once."""

    def __init__(self, uri: str):
        self.fs, self.root = file_system(uri)
        self.task = TaskContext.get()
        self.k, self.out, self.seen = 0, None, {}

    def _open(self) -> None:
        self.name = f"{self.task.partitionId():06d}-{self.k:04d}.tar"
        self.tmp = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
        self.out, self.at, self.seen = self.fs.open_output_stream(self.tmp), 0, {}

    def add(self, image: bytes) -> tuple[str, str, int, int]:
        if self.out is not None and self.at > SHARD_BYTES:
            self.close()
        if self.out is None:
            self._open()
        digest = hashlib.sha256(image).hexdigest()
        if digest not in self.seen:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
            self.out.write(image)
            self.out.write(b"\0" * (-len(image) % 512))
            self.seen[digest] = self.at + 512
            self.at += 512 + len(image) + -len(image) % 512
        return digest, self.name, self.seen[digest], len(image)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.fs.move(self.tmp, f"{self.root}/{self.name}")
            self.out, self.k = None, self.k + 1


def write_shards(docs: DataFrame, uri: str) -> DataFrame:
    """Writes the media of every whole text under ``uri``; returns the lazy index (INDEX)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(uri)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    rows.append((doc_id, len(raw), *shards.add(to_png(padded(raw)))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        shards.close()

    return base_columns(docs, "doc_id", "text").mapInArrow(run, INDEX)


def _ranges(index: DataFrame, uri: str, columns: list[tuple[str, pa.DataType, str]], look) -> DataFrame:
    """Adds what ``look(read, offset, length)`` finds at each row's range, once for rows of equal range."""
    kept = [f.name for f in index.schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(uri)
        name = file = place = found = None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(k).to_pylist() for k in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file, place = shard, fs.open_input_file(f"{root}/{shard}"), None
                if place != offset:
                    place, found = offset, look(file.read_at, offset, length)
                rows.append(found)
            cols = list(zip(*rows, strict=True)) or [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, t, _) in zip(cols, columns, strict=True))], names=[*kept, *(n for n, _, _ in columns)])

    near = index.repartition(partitions(index.sparkSession), "shard").sortWithinPartitions("shard", "offset")
    return near.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in index.schema), *(f"{n} {s}" for n, _, s in columns)]))


def header_columns(index: DataFrame, uri: str) -> DataFrame:
    """width, height, bit_depth and colour type of each image; reads HEADER bytes of it."""
    wanted = [(n, pa.int32(), "int") for n in ("width", "height", "bit_depth", "color_type")]
    return _ranges(index, uri, wanted, lambda read, offset, length: png_header(read(min(HEADER, length), offset)))


def payload_columns(index: DataFrame, uri: str) -> DataFrame:
    """Digests and the feature of each payload, from the stored bytes."""

    def look(read, offset: int, length: int) -> tuple:
        image = read(length, offset)
        payload, (width, height, _, _) = from_png(image), png_header(image[:HEADER])
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload, width, height)

    wanted = [("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]
    return _ranges(index, uri, wanted, look)


def store(docs: DataFrame) -> tuple[DataFrame, str]:
    """Writes shards and index to a new place in the shared folder; the index and the shards' address."""
    spark = docs.sparkSession
    uri = fresh_path(spark, "media")
    uri = uri if ":" in uri else f"file://{uri}"
    fs, root = file_system(uri)
    fs.create_dir(root, recursive=True)
    return materialize(write_shards(docs, uri), "media-index"), uri


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text and reads it back: the contract's columns, and shard, offset, width and height."""
    index, uri = store(docs)
    full = payload_columns(header_columns(index, uri), uri)
    return full.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


def open_tar(data: bytes) -> tarfile.TarFile:
    """A shard's bytes as an ordinary tar archive."""
    return tarfile.open(fileobj=io.BytesIO(data))
