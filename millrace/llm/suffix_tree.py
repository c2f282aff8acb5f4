"""Operator 2: LM scoring by a probabilistic suffix tree over words.

Model. Symbols are words and an end. A context (up to `depth` words that stand right before a symbol) can have
entries (context, symbol); an entry is kept if it occurs `least` times in training (a `least` below 1 is a share
of the training tokens), however large the corpus is. Root: P(w) = (c + 0.1) / (N + 0.1 (V + 1)).
Else, d = 0.5 being taken off each entry and n its count:
    P(w | s) = (n(s, w) - d) / n(s)  [if there is an entry]  +  g(s) P(w | next shorter state)
where g(s) is what the entries leave of 1. A context is a state of the tree if it passes the divergence test:
n(s) times the divergence of its distribution from that of the next shorter state is at least `nats`.
Each token is scored in the longest state that is a suffix of the words before it, within its document.

How it is computed. Texts are cut into words once; a row of the `chunks` table holds about a million tokens as numbers of
its distinct words and their 64-bit hashes. What goes between tasks are not rows of tokens but packed arrays:
- A chunk asks for the counts of its words, cut by hash into `parts` (as many as the corpus needs, so a part's arrays fit
  into a task); a part adds up what all chunks say and answers each of them with the words' counts and numbers.
- A window is a token and the words before it. A chunk sends its distinct windows, with their counts, to the part of the
  word right before the token. All contexts that end in a word, and all their entries, so meet in one part, which finds
  counts, g, states and log P of all levels by sorting, and answers each window with what they add to its log P.
- Windows go in `WAVES` of parts, one after the other, so that only a share of them and of their answers is on disk at a
  time; what a wave adds to each document's score is kept.
- A context that occurs `HOT` times or more would bring too much into one part. Level by level, chunks ask for the grams
  of such contexts by hash of the gram, as for words; sums over each such context's entries give g and whether it is a
  state (a row for each hot context comes to the driver: at most `depth` times tokens / HOT), and the chunks find log P of
  that level themselves. Windows then go to the part of their shortest context that isn't hot.
- Nothing is left out: every gram that occurs `least` times is an entry.
So the model is never collected or broadcast. Chunks are stored by buckets of their number, so that answers come to them
without the chunks moving. Words, and grams of hot contexts, are told apart by 64-bit hashes.

Edge cases: null or empty texts are the end alone; without training rows N = V = 0, so every token has
probability 1; rows that are repeated, or lack a doc_id (fold: not held out), are scored one by one; an empty table gives
no rows; columns other than doc_id and text, of whatever names, are not read; a document is never cut, so a very long
text makes a long chunk.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import coded, dropped, released, scratch, stored

DEPTH, LEAST, NATS, TAKEN = 3, 2, 10.0, 0.5
CHUNK = 1 << 20  #: tokens of a chunk
BUCKET = 2  #: chunks of a bucket, whose answers a task holds together
WORD = 5  #: bytes of a word and the white space behind it, for an estimate of the number of chunks
PART = 1 << 21  #: tokens for each part
HOT = 1 << 20  #: occurrences from which on a context's windows are too many for one part
VALUES = 1 << 19  #: values that are packed together
WAVES = 2  #: waves of parts; each costs two more readings of the chunks
LET_GO = 1.5  #: seconds; Python tells the JVM up to one second later that it refers to a table no more
ROWS = 256  #: packed rows that a task takes at a time
CHUNKS = "chunk long, docs binary, no_doc binary, held binary, sizes binary, words binary, tokens binary"
PACKED = "part int, chunk long, keys binary, counts binary"
QUESTIONS = "part int, chunk long, start int, data binary"
ANSWERS = "level int, part int, chunk long, answer binary"
SUMS = "context long, first double, second double"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
ALL, HOTTEST = -1, -2  #: instead of a chunk: what concerns a whole part
LAST = 100  #: level of the answers to windows, to which their start is added
GAINS = 200  #: level of what waves of windows add to the documents' scores


def folds(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))


def needed(least: float, total: int) -> int:
    """The number of occurrences that makes an entry."""
    return max(2, int(np.ceil(least * total if least < 1 else least)))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of them."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def hashed(word: bytes) -> bytes:
    return blake2b(word, digest_size=8).digest()


def root(c: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of the root's probability of words with counts c."""
    return np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))


def part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


@contextmanager
def few_rows_at_a_time(spark: SparkSession):
    """Tasks get packed rows, of megabytes each, in small batches while this lasts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def swept(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of tables that nothing refers to."""
    gc.collect()
    time.sleep(LET_GO)
    spark._jvm.System.gc()


def chunks_of(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The texts as packed tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        held: list[bool] = []
        lists: list[list[bytes]] = []

        def packed() -> pa.RecordBatch:
            words, at, n = coded(lists, pa.large_binary())
            tokens = np.insert(at, np.cumsum(n), len(words))  # behind each text the end
            hashes = np.frombuffer(b"".join([hashed(w) for w in words]) + hashed(b" "), "<u8")  # no word has a blank
            hashes, place = np.unique(hashes, return_inverse=True)
            row = (
                number, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], bool).tobytes(), np.array(held, bool).tobytes(),
                (n + 1).astype("<i8").tobytes(), hashes.tobytes(), place[tokens].astype("<u4").tobytes(),
            )
            return batch(CHUNKS, [row])

        count = 0
        for b in batches:
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                ids.append(i)
                held.append(h)
                lists.append((t.as_py() or "").encode().lower().split())
                count += len(lists[-1]) + 1
                if count >= size:
                    yield packed()
                    number, count = number + 1, 0
                    ids, held, lists = [], [], []
        if lists:
            yield packed()

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, CHUNKS)


def packed(columns: list[np.ndarray], at: int, to: int) -> bytes:
    """Rows at to `to` of what planes gives, compressed."""
    return squeezed(b"".join([c[..., at:to].tobytes() for c in columns]))


def squeezed(data: bytes) -> bytes:
    """Compressed data behind their size; a shuffle's own compression has no entropy code, which planes gain by."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(memoryview(data)[8:], size, asbytes=True) if size else b""


def planes(column: np.ndarray) -> np.ndarray:
    """Byte planes of unsigned numbers; signed ones and log P stay whole: they repeat, their bytes by themselves don't."""
    if column.dtype.kind in "if":
        return column
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), column.itemsize).T)


def unpacked(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The columns of a packed row."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    rows = np.frombuffer(unsqueezed(data), np.uint8).reshape(sum(sizes), -1)
    ends = np.cumsum(sizes)
    whole = [np.dtype(k).kind in "if" for k in kinds]
    return [np.ascontiguousarray(x if w else x.T).reshape(-1).view(k) for x, w, k in zip(np.split(rows, ends[:-1]), whole, kinds)]


def ordered(columns: list[np.ndarray], first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by `first` and the columns, and in this order whether a row differs from the one before it."""
    if columns[0].itemsize == 4:  # two at a time
        wide = [c.astype(np.uint64) for c in columns]
        keys = [x << np.uint64(32) | y for x, y in zip(wide[::2], wide[1::2])] + wide[len(wide) // 2 * 2 :]
    else:
        keys = list(columns)
    if first is not None:
        keys.insert(0, first)
    by = np.lexsort(keys[::-1]) if len(keys[0]) else np.zeros(0, np.int64)
    return by, changes([k[by] for k in keys])


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class Model:
    """What the driver knows: numbers, and the hot contexts level by level."""

    def __init__(self, depth: int, least: float, nats: float):
        self.depth, self.least, self.nats = depth, least, nats
        self.need, self.total, self.distinct, self.kind = 2, 0, 0, "<u4"
        self.bits, self.waves, self.many = 0, 1, HOT
        self.hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  #: of each level: ascending hashes, g, whether a state

    def root(self, c: np.ndarray) -> np.ndarray:
        return root(c, self.total, self.distinct)

    def kinds(self, start: int) -> list[str]:
        """Columns of windows that start there: words before the token, nearest first, the token, count, and the token's
        count or log P."""
        return [self.kind] * (self.depth + 1) + ["<u4", "<f8" if start else "<u8"]


class Chunk:
    """A chunk's tokens and what is known of them so far: of each token log P in the longest hot state, `low`."""

    def __init__(self, row: dict, model: Model):
        self.number, self.model = row["chunk"], model
        self.docs, self.no_doc = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["no_doc"], bool)
        self.held, self.sizes = np.frombuffer(row["held"], bool), np.frombuffer(row["sizes"], "<i8")
        self.words, self.tokens = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["tokens"], "<u4")
        self.first = np.cumsum(self.sizes) - self.sizes
        self.answers: dict[int, list[bytes]] = {}
        for a in row["answers"] or []:
            self.answers.setdefault(a["level"], []).append(a["answer"])
        if 0 not in self.answers:
            return
        self.place = np.arange(len(self.tokens)) - np.repeat(self.first, self.sizes)
        known = [unpacked(a, ["<u8", "<u8"]) for a in self.answers[0]]
        counts, numbers = (np.concatenate(x) for x in zip(*known))
        self.counts, self.numbers = counts[self.tokens], numbers.astype(model.kind)[self.tokens]
        self.base = model.root(counts)[self.tokens]
        self.low = self.base.copy()
        self.start = np.zeros(len(self.tokens), np.int8)  #: hot levels of each token
        self.behind = self.counts  #: counts of the last level's grams, those of hot contexts
        for k in range(1, len(model.hot) + 1):
            self.learn(k)

    def train(self) -> np.ndarray:
        return ~np.repeat(self.held, self.sizes)

    def gram(self, t: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k + 1 symbols up to each token of t."""
        x = self.words[self.tokens[t]]
        for j in range(1, k + 1):
            x = mixed(x, self.words[self.tokens[t - j]])
        return x

    def hot(self, k: int) -> np.ndarray:
        """Tokens whose context of k words is hot."""
        t = np.flatnonzero(self.start == k - 1)
        t = t[self.place[t] >= k]
        return t[self.behind[t - 1] >= self.model.many]

    def question(self, k: int) -> Iterator[tuple]:
        """Distinct words, or grams of hot contexts, with their counts in training; context and log P one level lower."""
        if not k:
            keys = self.words
            columns = [keys, np.bincount(self.tokens[self.train()], minlength=len(keys)).astype("<u8")]
        else:
            t = self.hot(k)
            keys, first, at = np.unique(self.gram(t, k), return_index=True, return_inverse=True)
            columns = [keys, np.bincount(at, self.train()[t], len(keys)).astype("<u8"), self.gram(t[first] - 1, k - 1).view("<i8"), self.low[t[first]]]
        columns = [planes(c) for c in columns]
        for p, i, j in cut(keys, self.model.bits):
            yield p, self.number, 0, packed(columns, i, j)

    def learn(self, k: int) -> None:
        """Takes the answer to question(k) and log P of level k."""
        t = self.hot(k)
        _, at = np.unique(self.gram(t, k), return_inverse=True)
        n = np.concatenate([np.zeros(0, "<u8"), *[unpacked(a, ["<u8"])[0] for a in self.answers.get(k, [])]])[at].astype(np.int64)
        contexts, g, state = self.model.hot[k - 1]
        found = np.searchsorted(contexts, self.gram(t - 1, k - 1))
        whole, low = self.behind[t - 1].astype(np.int64), self.low[t]
        p = np.where(n >= self.model.need, n - TAKEN, 0.0) / whole + g[found] * 10.0**low
        self.low[t] = np.where(state[found], np.log10(p), low)
        self.start[t] = k
        self.behind = np.zeros(len(self.tokens), np.int64)
        self.behind[t] = n

    def windows(self, wave: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """start, part, and tokens in order of part and words with whether each window is a new one: of the tokens that have
        a context left which can have entries, in a part of the wave."""
        depth = self.model.depth
        for start in range(min(depth, len(self.model.hot) + 1)):
            t = np.flatnonzero((self.start == start) & (self.place > start))
            if not start:
                t = t[self.counts[t - 1] >= self.model.need]
            part = part_of(self.gram(t - 1, start), self.model.bits)
            mine = part % self.model.waves == wave
            t, part = t[mine], part[mine]
            by, new = ordered([*self.before(t), self.numbers[t]], part.astype(np.uint16 if self.model.bits <= 16 else np.int64))
            yield start, part[by], t[by], new

    def before(self, t: np.ndarray) -> list[np.ndarray]:
        """Numbers of the words before each token, nearest first; 0 where there is none."""
        return [np.where(self.place[t] >= k, self.numbers[np.maximum(t - k, 0)], self.numbers.dtype.type(0)) for k in range(1, self.model.depth + 1)]

    def asked(self, wave: int) -> Iterator[tuple]:
        """Packed windows of a wave."""
        train = self.train()
        for start, part, t, new in self.windows(wave):
            at = np.flatnonzero(new)
            if not len(at):
                continue
            n, one = np.add.reduceat(train[t].astype("<u4"), at, dtype="<u4"), t[at]
            columns = [planes(c) for c in [*self.before(one), self.numbers[one], n, self.low[one] if start else self.counts[one].astype("<u8")]]
            for p, i, j in runs(part[at]):
                yield p, self.number, start, packed(columns, i, j)

    def added(self, x: np.ndarray) -> np.ndarray:
        """Sums over the tokens of each document."""
        return np.add.reduceat(x, self.first) if len(self.first) else np.zeros(0)

    def gained(self, wave: int) -> np.ndarray:
        """What the answers to a wave's windows add to each document's score."""
        gain = np.zeros(len(self.tokens))
        for start, _, t, new in self.windows(wave):
            if len(t):
                gain[t] = np.concatenate([np.frombuffer(unsqueezed(a), "<f8") for a in self.answers[LAST + start]])[np.cumsum(new) - 1]
        return self.added(gain)

    def settled(self, wave: int) -> pa.RecordBatch:
        """What a wave adds, as an answer to this chunk."""
        return batch(ANSWERS, [(GAINS, wave, self.number, squeezed(self.gained(wave).tobytes()))])

    def scored(self) -> pa.RecordBatch:
        """The scores, when all waves but the last are settled and its answers are here."""
        score = self.added(self.low) + self.gained(self.model.waves - 1)
        for a in self.answers.get(GAINS, []):
            score += np.frombuffer(unsqueezed(a), "<f8")
        add = self.added
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.docs, pa.int64(), mask=self.no_doc), pa.array(self.held), pa.array(self.sizes, pa.int64()),
                pa.array(add((self.counts > 0).astype(np.int64)), pa.int64()), pa.array(add(self.base)), pa.array(score),
            ],
            names=[f.split()[0] for f in SCORES.split(", ")],
        )


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of an ascending array."""
    found, first = np.unique(x, return_index=True)
    return list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(x)]))


def cut(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of ascending keys."""
    return runs(part_of(keys, bits))


def in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of QUESTIONS, some megabytes at a time."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size >= 4 << 20:
            yield batch(QUESTIONS, held)
            held, size = [], 0
    if held:
        yield batch(QUESTIONS, held)


def parts(questions: DataFrame, bits: int, run) -> DataFrame:
    """run(part, start, chunks, data) for the questions of each part; it gives rows of ANSWERS."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for (part, start), group in groupby(rows, lambda r: (r["part"], r["start"])):
            chunks, data = zip(*[(r["chunk"], r["data"]) for r in group])
            yield from run(part, start, chunks, data)

    return questions.repartition(1 << bits, "part").sortWithinPartitions("part", "start", "chunk").mapInArrow(each, ANSWERS)


def columns_of(data: tuple[bytes, ...], kinds: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of many packed rows, and where each of them ends."""
    rows = [unpacked(d, kinds) for d in data]
    return [np.concatenate(c) for c in zip(*rows)], np.cumsum([len(r[0]) for r in rows])


def replies(level: int, part: int, chunks: tuple[int, ...], ends: np.ndarray, data) -> Iterator[pa.RecordBatch]:
    """Answers to chunks; data(from, to): what of a part's rows goes to one of them."""
    rows = [(level, part, c, data(i, j)) for c, i, j in zip(chunks, np.r_[0, ends[:-1]].tolist(), ends.tolist())]
    for at in range(0, len(rows), ROWS):
        yield batch(ANSWERS, rows[at : at + ROWS])


def counted_words(questions: DataFrame, bits: int, many: int) -> DataFrame:
    """Answers with counts and numbers of words, frequent ones first; of each part, as chunk ALL, the sum and the number of
    counts that aren't 0, and the largest number; as chunk HOTTEST the words that occur `many` times, but the end, and how often."""

    def run(part: int, _: int, chunks: tuple, data: tuple) -> Iterator[pa.RecordBatch]:
        (keys, n), ends = columns_of(data, ["<u8", "<u8"])
        found, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, n, len(found)).astype("<u8")
        number = np.empty(len(found), "<u8")
        number[np.argsort(-total.astype(np.int64), kind="stable")] = (np.arange(len(found), dtype=np.uint64) << np.uint64(bits)) + np.uint64(part + 1)
        sides = [planes(total[at]), planes(number[at])]
        yield from replies(0, part, chunks, ends, lambda i, j: packed(sides, i, j))
        hot = (total >= many) & (found != np.frombuffer(hashed(b" "), "<u8"))
        yield batch(ANSWERS, [(0, part, ALL, np.array([total.sum(), (total > 0).sum(), number.max()], "<u8").tobytes()), hottest(0, part, found[hot], total[hot])])

    return parts(questions, bits, run)


def hottest(level: int, part: int, keys: np.ndarray, n: np.ndarray) -> tuple:
    return level, part, HOTTEST, packed([planes(keys), planes(n)], 0, len(keys))


def hot_contexts(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the contexts that are hot one level up, and their counts: a row for each part comes to the driver."""
    rows = answers.where(F.col("chunk") == HOTTEST).select("answer").toArrow().column(0).to_pylist()
    keys, n = (np.concatenate([np.zeros(0, "<u8"), *x]) for x in zip(*[unpacked(r, ["<u8", "<u8"]) for r in rows] or [((), ())]))
    by = np.argsort(keys)
    return keys[by], n[by].astype(np.int64)


def counted_grams(questions: DataFrame, level: int, bits: int, need: int, many: int) -> DataFrame:
    """Answers with counts of grams; of each part, as chunk ALL, context, count and lower log P of all entries, and as chunk
    HOTTEST the grams that occur `many` times, and how often."""

    def run(part: int, _: int, chunks: tuple, data: tuple) -> Iterator[pa.RecordBatch]:
        (keys, n, context, low), ends = columns_of(data, ["<u8", "<u8", "<i8", "<f8"])
        found, first, at = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(at, n, len(found)).astype("<u8")
        sides = [planes(total[at])]
        yield from replies(level, part, chunks, ends, lambda i, j: packed(sides, i, j))
        e = total >= need
        of_all = (level, part, ALL, packed([planes(c) for c in (context[first][e], total[e], low[first][e])], 0, int(e.sum())))
        yield batch(ANSWERS, [of_all, hottest(level, part, found[total >= many], total[total >= many])])

    return parts(questions, bits, run)


def summed(answers: DataFrame, add) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending contexts of the entries that counted_grams found, and sums of the two numbers that add gives of each entry
    from its context, count and lower log P: a row for each hot context comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                context, n, low = unpacked(data, ["<i8", "<u8", "<f8"])
                context = context.view("<u8")
                found, at = np.unique(context, return_inverse=True)
                sums = [pa.array(np.bincount(at, x, len(found)), pa.float64()) for x in add(context, n.astype(np.float64), low)]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *sums], names=[f.split()[0] for f in SUMS.split(", ")])

    rows = answers.where(F.col("chunk") == ALL).select("answer").mapInArrow(run, SUMS)
    rows = rows.groupBy("context").agg(F.sum("first").alias("first"), F.sum("second").alias("second")).toArrow()
    context = np.array(rows.column(0), np.int64).view(np.uint64)
    by = np.argsort(context)
    return context[by], np.array(rows.column(1), np.float64)[by], np.array(rows.column(2), np.float64)[by]


def hot_states(answers: DataFrame, whole: tuple[np.ndarray, np.ndarray], nats: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending contexts, g, and whether a state, of the hot contexts; whole: ascending contexts and their counts."""
    contexts, n = whole
    found, used, inside = summed(answers, lambda context, n, low: (n - TAKEN, n))
    at = np.searchsorted(contexts, found)
    g, rest = np.ones(len(contexts)), n.astype(np.float64)
    g[at] = np.maximum(1 - used / n[at], 1e-12)
    rest[at] -= inside

    def gains(context: np.ndarray, m: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(contexts, context)
        return m * (np.log10((m - TAKEN) / n[i] + g[i] * 10.0**low) - low), np.zeros(len(m))

    _, gain, _ = summed(answers, gains)
    state = np.zeros(len(contexts), bool)
    state[at] = (gain + rest[at] * np.log10(g[at])) * np.log(10) >= nats
    return contexts, g, state


def window_scores(columns: list[np.ndarray], start: int, model: Model) -> np.ndarray:
    """What states of start + 1 words and more add to log P of windows of a part that holds all windows of such contexts; 0
    where none of them has a say. Windows of a context that are no entries of it share one number, so repeats are many."""
    depth = model.depth
    by, new = ordered(columns[: depth + 1])
    at = np.flatnonzero(new)
    n = np.add.reduceat(columns[depth + 1][by].astype(np.int64), at)
    one = by[at]  # from here on distinct windows, in order
    words, last = [c[one] for c in columns[:depth]], columns[depth][one]
    floor = columns[depth + 2][one] if start else model.root(columns[depth + 2][one])
    low, added = floor, np.zeros(len(one))
    if last.itemsize > 4:
        last = np.unique(last, return_inverse=True)[1]
    last = last.astype(np.int64)
    fresh = changes(words[:start]) if start else np.zeros(len(one), bool)
    for k in range(start + 1, depth + 1):
        fresh = fresh | changes([words[k - 1]])
        context = np.cumsum(fresh) - 1
        key = context << 32 | last
        if k < depth:
            _, first, gram = np.unique(key, return_index=True, return_inverse=True)
            count = np.bincount(gram, n, len(first)).astype(np.int64)
        else:  # a row is a gram
            first = gram = np.arange(len(one))
            count = n
        whole = np.add.reduceat(n, np.flatnonzero(fresh))
        entry = (count >= model.need) & (words[k - 1][first] > 0)
        e, m = first[entry], count[entry].astype(np.float64)  # the entries' first rows, and their counts
        c, size = context[e], len(whole)
        g = np.maximum(1 - np.bincount(c, m - TAKEN, size) / np.maximum(whole, 1), 1e-12)
        p = np.log10((m - TAKEN) / whole[c] + g[c] * 10.0 ** low[e])
        gain = np.bincount(c, m * (p - low[e]), size) + (whole - np.bincount(c, m, size)) * np.log10(g)
        state = (gain * np.log(10) >= model.nats) & (np.bincount(c, minlength=size) > 0)
        higher = added + np.log10(g)[context]  # of what is no entry
        of = np.full(len(first), -1)
        of[entry] = np.arange(len(e))
        of = of[gram]
        if len(p):
            higher = np.where(of >= 0, (p - floor[e])[of], higher)
        added = np.where(state[context], higher, added)
        low = floor + added
    out = np.empty(len(by))
    out[by] = added[np.cumsum(new) - 1]
    return out


def answered_windows(questions: DataFrame, model: Model) -> DataFrame:
    def run(part: int, start: int, chunks: tuple, data: tuple) -> Iterator[pa.RecordBatch]:
        columns, ends = columns_of(data, model.kinds(start))
        found = window_scores(columns, start, model)
        yield from replies(LAST + start, part, chunks, ends, lambda i, j: squeezed(found[i:j].tobytes()))  # whole numbers repeat, their bytes don't

    return parts(questions, model.bits, run)


def packed_values(values: DataFrame, bits: int) -> DataFrame:
    """Rows (key, value) as packed arrays of their parts: keys and, in the place of counts, values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            keys, v = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(keys)
            keys, v = keys[by], v[by]
            return batch(PACKED, [(p, ALL, keys[i:j].tobytes(), v[i:j].tobytes()) for p, i, j in cut(keys, bits)])

        for b in batches:  # batches are small, and a packed row of few values costs more than they do
            held.append((np.array(b.column(0)).view(np.uint64), np.array(b.column(1))))
            if sum(len(k) for k, _ in held) >= VALUES:
                yield packed()
                held.clear()
        if held:
            yield packed()

    return values.select("key", "value").mapInArrow(run, PACKED)


class Corpus:
    """The stored chunks with the answers they have got, by buckets of their numbers."""

    def __init__(self, rows: DataFrame, depth: int):
        self.spark, self.depth = rows.sparkSession, depth
        held = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
        least = max(rows.rdd.getNumPartitions(), self.spark.sparkContext.defaultParallelism)
        self.name, self.buckets = f"millrace_{uuid.uuid4().hex}", min(max(least, -(-held // (WORD * CHUNK * BUCKET))), 100_000)  # Spark has no more
        path = scratch(self.spark, "chunks")
        chunks_of(rows).write.bucketBy(self.buckets, "chunk").sortBy("chunk").option("compression", "zstd").option("path", path).saveAsTable(self.name)
        self.answers: list[DataFrame] = []
        self.levels = 0  #: how many of them have been asked for

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def with_answers(self) -> DataFrame:
        """Each chunk with all its answers, in order of level and part: only answers move."""
        rows = self.table()
        if not self.answers:
            return rows.withColumn("answers", F.lit(None).cast("array<struct<level:int,part:int,answer:binary>>"))
        every = self.answers[0]
        for a in self.answers[1:]:
            every = every.unionByName(a)
        by = every.where(F.col("chunk") >= 0).repartition(self.buckets, "chunk").groupBy("chunk")
        return rows.join(by.agg(F.array_sort(F.collect_list(F.struct("level", "part", "answer"))).alias("answers")), "chunk", "left")

    def each(self, model: Model, run, schema: str) -> DataFrame:
        """run(chunk) of all chunks, each of which gives batches."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    yield from run(Chunk(row, model))

        return self.with_answers().mapInArrow(each, schema)

    def ask(self, model: Model, k: int) -> DataFrame:
        """The questions of level k."""
        return self.each(model, lambda c: in_batches(c.question(k)), QUESTIONS)

    def windows(self, model: Model, wave: int) -> DataFrame:
        return self.each(model, lambda c: in_batches(c.asked(wave)), QUESTIONS)

    def settled(self, model: Model, wave: int) -> DataFrame:
        return self.each(model, lambda c: [c.settled(wave)], ANSWERS)

    def scores(self, model: Model) -> DataFrame:
        return self.each(model, lambda c: [c.scored()], SCORES)

    def close(self) -> None:
        path = self.table().inputFiles()
        self.spark.sql(f"DROP TABLE {self.name}")
        if path:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path[0].rsplit("/", 1)[0])
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def lm_scores(docs: DataFrame, depth: int = DEPTH, least: float = LEAST, nats: float = NATS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    model = Model(depth, least, nats)
    with few_rows_at_a_time(spark):
        corpus = Corpus(folds(docs), depth)
        tokens = corpus.table().agg(F.coalesce(F.sum(F.length("tokens") / 4), F.lit(0))).first()[0]
        model.bits = max(0, int(tokens // PART).bit_length())
        model.waves = min(WAVES, 1 << model.bits)
        corpus.answers.append(stored(counted_words(corpus.ask(model, 0), model.bits, model.many), "words"))
        sums = corpus.answers[0].where(F.col("chunk") == ALL).select("answer").toArrow().column(0).to_pylist()  # a row for each part
        sums = [np.frombuffer(s, "<u8") for s in sums] or [np.zeros(3, "<u8")]
        model.total, model.distinct, top = (int(x) for x in (*np.sum(sums, axis=0)[:2], np.max(sums, axis=0)[2]))
        model.need, model.kind = needed(least, model.total), "<u4" if top < 1 << 32 else "<u8"
        swept(spark)
        for k in range(1, depth + 1):
            hot = hot_contexts(corpus.answers[-1])
            if not len(hot[0]):
                break
            corpus.answers.append(stored(counted_grams(corpus.ask(model, k), k, model.bits, model.need, model.many), f"grams-{k}"))
            model.hot.append(hot_states(corpus.answers[-1], hot, nats))
            swept(spark)
        for wave in range(model.waves - 1):
            corpus.answers.append(answered_windows(corpus.windows(model, wave), model))
            corpus.answers[-1] = stored(corpus.settled(model, wave), f"gains-{wave}")
            swept(spark)
        before = list(corpus.answers)
        corpus.answers.append(answered_windows(corpus.windows(model, model.waves - 1), model))
        out = stored(corpus.scores(model), "scores")
        corpus.answers.clear()
        dropped(spark, *before)
        corpus.close()
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
