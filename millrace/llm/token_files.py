"""Operator 5: token ids in binary files, by canonical length-limited Huffman coding.

One pass encodes the texts and stores the ids; global counts (a row for each id of the vocabulary, so their
size is bounded by it) give code lengths of at most `most` bits by package-merge, and codes follow from
lengths alone. A range exchange on doc_id makes shards; each shard is a run of independent blocks, which
hold whole documents in ascending doc_id order: ids of documents, numbers of ids, the bit string, and the
bit offset of every 256th id. A reader decodes all stretches between two checkpoints of a block in step by
one table of 2^most entries. Blocks are rows of a Parquet table: any store that Spark reaches will do.

Edge cases: null and empty texts have the end id alone; rows of equal doc_id lie side by side, in order of
length and checksum; documents without doc_id come first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .library import library, place

MOST = 16  #: bits of the longest code
EVERY = 256  #: ids between two checkpoints
BLOCK = 1 << 18  #: ids after which a block ends
SHARD = 1 << 22  #: ids a shard holds on average,
SHARDS = 1 << 12  #: as long as there are no more shards than these; from there on shards grow, up to 16 times
GROUP = 1 << 22  #: characters that are encoded together
END = 2
IDS = "doc_id long, n long, crc long, ids binary"
BLOCKS = "shard int, block int, before long, n_ids long, doc_ids binary, no_id binary, sizes binary, checkpoints binary, bits binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def code_lengths(counts: np.ndarray, most: int = MOST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `most` bits (package-merge); 0 where a count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids don't fit into codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    level, is_coin, kinds = coins, np.ones(len(coins), bool), []
    for _ in range(most):
        kinds.append(is_coin)
        packs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.r_[coins, packs]
        by = np.argsort(both, kind="stable")
        level, is_coin = both[by], by < len(coins)
    take = 2 * len(coins) - 2
    for kind in reversed(kinds):
        n = int(kind[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes that follow from lengths: shorter ones first, ids of equal length in ascending order."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            codes[i], last = code, int(lengths[i])
            code += 1
    return codes


class Code:
    def __init__(self, lengths: np.ndarray, most: int = MOST):
        if most > 24:
            raise ValueError("codes of up to 24 bits")
        self.most, self.lengths, self.codes = most, lengths, canonical(lengths)
        self.symbol, self.size = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.uint8)
        used = np.flatnonzero(lengths)
        by = used[np.argsort(self.codes[used] << (most - lengths[used]).astype(np.uint64))]
        spans = 1 << (most - lengths[by])
        n = int(spans.sum())
        self.symbol[:n], self.size[:n] = np.repeat(by, spans), np.repeat(lengths[by], spans)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string and the bit offsets of the checkpoints."""
        size = self.lengths[ids]
        if len(ids) and not size.min():
            raise ValueError("an id without a code")
        ends = np.cumsum(size)
        at = ends - size
        n = (int(ends[-1]) + 7 >> 3) if len(ids) else 0
        if not n:
            return bytes(4), at.astype("<u8")
        value, word, left = self.codes[ids], at >> 6, 64 - (at & 63) - size  # left: bits behind the code in its 64-bit word
        over = np.flatnonzero(left < 0)  # at most one code of a word goes on in the next
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word[over] + 1] = value[over] << (64 + left[over]).astype(np.uint64)
        head = value << np.maximum(left, 0).astype(np.uint64)
        head[over] = value[over] >> (-left[over]).astype(np.uint64)
        out[: int(word[-1]) + 1] += np.add.reduceat(head, np.searchsorted(word, np.arange(int(word[-1]) + 1)))  # codes are shorter than a word, so one begins in each
        return out.astype(">u8").tobytes()[:n] + bytes(4), at[::EVERY].astype("<u8")

    def unpack(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at, last = checkpoints.astype(np.int64), len(window) - 1
        out = np.empty((min(n, EVERY), len(at)), np.uint32)
        for k in range(len(out)):
            found = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> np.uint32(32 - self.most)
            out[k] = self.symbol[found]
            at += self.size[found]
        return out.T.reshape(-1)[:n] if len(out) == EVERY else out.T.reshape(-1)


def widened(raw: bytes) -> np.ndarray:
    """Ids that are stored as 16-bit or 32-bit numbers; a mark behind them tells which."""
    return np.frombuffer(raw, "<u2" if raw[-1:] == b"2" else "<u4", (len(raw) - 1) // int(raw[-1:]))


def encoded(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """A stored table of the ids of each document, the end id behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(path or place("word_bpe_49k.json"))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            sizes = list(map(len, texts))
            at = 0
            while at < len(sizes):
                stop, held = at + 1, sizes[at]
                while stop < len(sizes) and held + sizes[stop] <= GROUP:
                    held += sizes[stop]
                    stop += 1
                flat, n = lib.encode(texts[at:stop])
                flat = np.insert(flat, np.cumsum(n), end).astype("<u4")  # an end behind each document
                cut = np.r_[0, np.cumsum(n + 1)].tolist()
                raw = memoryview(flat.tobytes())
                short = memoryview(flat.astype("<u2").tobytes()) if flat.max() < 1 << 16 else None
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[at:stop].cast(pa.int64()), pa.array(n + 1, pa.int64()), pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(cut, cut[1:])], pa.int64()),
                        pa.array([bytes(short[2 * i : 2 * j]) + b"2" if short else bytes(raw[4 * i : 4 * j]) + b"4" for i, j in zip(cut, cut[1:])], pa.binary()),
                    ],
                    names=["doc_id", "n", "crc", "ids"],
                )
                at = stop

    return stored(docs.select("doc_id", "text").mapInArrow(run, IDS), "token-ids")


def global_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs; at most a row for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.concatenate([np.zeros(0, np.uint16), *map(widened, b.column(0).to_pylist())]))
            total = np.pad(total, (0, max(0, len(n) - len(total)))) + np.pad(n, (0, max(0, len(total) - len(n))))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_blocks(ids: DataFrame, code: Code, total: int, shard_ids: int = SHARD, block_ids: int = BLOCK) -> DataFrame:
    """Shards of blocks in ascending doc_id order, as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            bits, checkpoints = code.pack(flat)
            row = [
                shard, block, before, len(flat), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs]).tobytes(),
                np.array([len(p) for p in parts], "<u4").tobytes(), checkpoints.tobytes(), bits,
            ]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        held = 0
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                docs.append(d)
                parts.append(widened(x.as_py()))
                held += len(parts[-1])
                if held >= block_ids:
                    yield flush()
                    block, before, held = block + 1, before + held, 0
                    docs, parts = [], []
        if docs:
            yield flush()

    shards = max(1, min(-(-total // shard_ids), SHARDS), -(-total // (16 * shard_ids)))
    dealt = ids.repartitionByRange(shards, "doc_id", "n", "crc").sortWithinPartitions("doc_id", "n", "crc")
    return stored(dealt.select("doc_id", "ids").mapInArrow(run, BLOCKS), "token-blocks")


def read_blocks(blocks: DataFrame, code: Code) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the blocks."""
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # 1 row for SHARD ids
    order = sorted(totals)
    base = dict(zip(order, accumulate((totals[s] for s in order), initial=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = code.unpack(r["bits"], np.frombuffer(r["checkpoints"], "<u8"), r["n_ids"])
                size = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
                ends = np.cumsum(size)
                raw = memoryview(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(r["no_id"], bool)),
                        pa.array(ends - size + r["before"] + base[r["shard"]], pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array([zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(size.tolist(), ends.tolist())], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.mapInArrow(run, RESULT)


def token_files(docs: DataFrame, path: str | None = None, end: int = END, most: int = MOST) -> DataFrame:
    """Writes all ids to blocks and returns what a reader of the blocks finds."""
    ids = encoded(docs, path, end)
    counts = global_counts(ids)
    code = Code(code_lengths(counts, most), most)
    return read_blocks(write_blocks(ids, code, int(counts.sum())), code)
