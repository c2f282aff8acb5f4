"""Operator 1: media columns. Content-addressed payloads in tar shards; rows carry digest, offset and length.

A payload is a text's UTF-8, filled up with blanks to a positive multiple of 192 bytes. It is stored
losslessly as the 8-bit grey samples of a PNG of 192 samples a row. Each task appends its payloads to tar
shards of its own in the shared folder; a member's name is its payload's SHA-256 and a shard's writer
stores a digest once, however many of its rows have it, so a text that a third of all rows share costs
one member a task and moves nothing over the network. A shard's name is new for each attempt of a task: a
lost executor leaves at most a shard that no row names. `index_of` gives the rows, `metadata` fills
width, height, bit depth and colour type from the first 33 bytes of each member alone, and `features`
reads members back and computes what depends on their content.

Edge cases: null and empty texts are 192 blanks; equal texts have equal digests and features; rows are
otherwise independent, and an empty table gives no shards and no rows; columns other than doc_id and text, of whatever
names, are not read; a very long text needs a few times its own size.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

ROW = 192
SHARD_BYTES = 64 << 20
SEEN = 100_000  #: digests or members that a writer or reader remembers
READ = 16 << 20  #: bytes of members that a task reads back
HEAD = 33  #: bytes of a PNG's signature and header
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
META = INDEX + ", width int, height long, bit_depth int, colour int"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, width int, height long, shard string, offset long"
)
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the size of the text."""
    data = (text or "").encode()
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" "), len(data)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    header = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from a PNG's first HEAD bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG as to_png writes it."""
    width, height, depth, colour = header_of(data[:HEAD])
    if (depth, colour) != (8, 0):
        raise ValueError("only 8-bit grey")
    at, parts = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("checksum of a PNG chunk")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only filter type 0")
    return rows[:, 1:].tobytes()


class ShardWriter:
    """Appends members to tar shards of at most about `most` bytes each."""

    def __init__(self, folder: str, most: int):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.uri, self.most = folder, most
        self.out = None
        self.seen: dict[str, tuple[str, int, int]] = {}

    def add(self, digest: str, payload: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of the member."""
        if (found := self.seen.get(digest)) is not None:
            return found
        data = to_png(payload)
        if self.out is None or self.at + len(data) > self.most:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        header = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
        self.out.write(header + data + bytes(-len(data) % 512))
        found = f"{self.uri}/{self.name}", self.at + len(header), len(data)
        self.at += len(header) + len(data) + -len(data) % 512
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen[digest] = found
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


class ShardReader:
    """Range reads; holds one shard open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, size: int) -> bytes:
        if uri != self.uri:
            self.close()
            fs, path = pa.fs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        return self.file.read_at(size, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri = self.file = None


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def index_of(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the payloads and returns a stored table of their rows."""
    folder = folder or scratch(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder, shard_bytes)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                payload, n = payload_of(text.as_py())
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((doc_id, n, digest, *writer.add(digest, payload)))
            yield batch(INDEX, rows)
        writer.close()

    return stored(docs.select("doc_id", "text").mapInArrow(run, INDEX), "media-index")


def metadata(index: DataFrame) -> DataFrame:
    """index with width, height, bit depth and colour type, from header-only range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader()
        for b in batches:
            rows = [tuple(r.values()) for r in b.to_pylist()]
            yield batch(META, [(*r, *header_of(reader.read(r[3], r[4], HEAD))) for r in rows])
        reader.close()

    return index.select(*INDEX_COLUMNS).mapInArrow(run, META)


def feature_of(samples: bytes) -> str:
    """Mean, deviation and an average hash over 64 equal parts of the samples."""
    x = np.frombuffer(samples, np.uint8)
    edges = np.arange(64) * len(x) // 64
    parts = np.add.reduceat(x, edges, dtype=np.int64) / np.diff(np.r_[edges, len(x)])
    bits = int("".join("1" if p > x.mean() else "0" for p in parts), 2)
    return f"{x.mean():.4f}:{x.std():.4f}:{bits:016x}"


def features(rows: DataFrame) -> DataFrame:
    """What the contract names, from the members as they are read back; rows: a result of metadata().

    Each member, that is each shard and offset, is read; rows that name the same one take what was found there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = ShardReader(), {}
        for b in batches:
            out = []
            for doc_id, n, digest, shard, offset, length, width, height, _, _ in map(lambda r: tuple(r.values()), b.to_pylist()):
                if (found := seen.get((shard, offset))) is None:
                    data = reader.read(shard, offset, length)
                    payload = from_png(data)
                    found = (
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        feature_of(payload),
                    )
                    if found[0] != digest:
                        raise ValueError(f"{shard} at {offset}: content {found[0]}, not {digest}")
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[shard, offset] = found
                out.append((doc_id, n, width * height, *found, width, height, shard, offset))
            yield batch(FEATURES, out)
        reader.close()

    return rows.mapInArrow(run, FEATURES)


def spread(index: DataFrame, read: int = READ) -> DataFrame:
    """The rows of an index in order of their members, dealt so that a task reads about `read` bytes."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return index.repartitionByRange(max(1, -(-size // read)), "shard", "offset", "doc_id")


INDEX_COLUMNS = [f.split()[0] for f in INDEX.split(", ")]


def media_columns(docs: DataFrame) -> DataFrame:
    return features(metadata(spread(index_of(docs))))
