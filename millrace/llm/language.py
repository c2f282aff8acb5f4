"""Operator 6: language identification by averaged hashed subword embeddings.

Features are the byte n-grams (n = 2, 3, 4) of the lower-cased text with white space made one blank, hashed
into `buckets` rows of an embedding matrix; a text is the average of its rows, a linear softmax gives the
languages. Embeddings and weights are trained together by stochastic gradient descent in numpy on the
driver, on a sample of labelled rows (`SAMPLE`, a parameter): those of least hash of doc_id, drawn evenly from
the languages, one row of each at least; longer texts are trained on in pieces from all over them. A fifth of the
sample is kept back: on it, on whole texts, a temperature is fitted, so that the score is a probability, and the
rejection threshold is set as the score that all but `SLACK` of correctly labelled texts exceed. For prediction,
embedding and weights are multiplied out (bucket x language), which is what executors get; its size is fixed by the
parameters. A text's n-grams are counted in slices of its bytes, none being lost or changed where slices meet.

Edge cases: null text, or text without a letter, is `und` with score 0 and rejected; without any labelled
row every text is `und`; ties between languages go to the first in alphabetical order; repeated rows and
other columns, of whatever names, change nothing; an empty table gives no rows; a very long text needs a few times its
own size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored, trimmed
from .near_dedup import few

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
BUCKETS, DIM, SAMPLE, HEAD = 1 << 16, 16, 4000, 1500
EPOCHS, BATCH, RATE, SEED, SLACK = 6, 32, 0.5, 7, 0.001
ORDERS = (2, 3, 4)
SLICE = 1 << 18
SPACES = re.compile(r"[\W\d_]+")


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  #: bucket x language: embedding times weights
    bias: np.ndarray
    temperature: float
    threshold: float


def cleaned(text: str) -> np.ndarray:
    """Bytes of a text that is made lower case, runs of other than letters being one blank, a blank on both sides."""
    return np.frombuffer((" " + SPACES.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace"), np.uint8)


def hashes(data: np.ndarray, start: int, stop: int, size: int) -> np.ndarray:
    """Buckets of the n-grams that begin at start..stop of the bytes, whatever the stretch they are cut into."""
    gram = part = data[start : stop + max(ORDERS) - 1].astype(np.uint32)
    parts = []
    for n in range(2, max(ORDERS) + 1):
        if len(part) < n:
            break
        gram = (gram[:-1] << np.uint32(8)) | part[n - 1 :]
        if n in ORDERS:
            mixed = (gram[: stop - start] + np.uint32(n)) * np.uint32(0x9E3779B1)
            parts.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - int(math.log2(size))))
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def buckets_of(text: str, size: int = BUCKETS) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    data = cleaned(text)
    return hashes(data, 0, len(data), size)


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(c.isalpha() for c in text))


def logits(text: str, m: Model) -> np.ndarray:
    """Sum over the text's n-grams, SLICE bytes at a time, divided by their number."""
    total, n, data = np.zeros(len(m.langs)), 0, cleaned(text)
    for at in range(0, len(data), SLICE):
        b = hashes(data, at, min(len(data), at + SLICE), len(m.scores))
        total += np.bincount(b, minlength=len(m.scores)) @ m.scores if len(b) > 20_000 else m.scores[b].sum(0)
        n += len(b)
    return total / max(n, 1) + m.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def predict(text: str | None, m: Model) -> tuple[str, float, bool]:
    if not m.langs or not has_letter(text):
        return "und", 0.0, True
    p = softmax(logits(text, m) / m.temperature)
    k = int(p.argmax())
    return m.langs[k], float(min(1.0, p[k])), bool(p[k] < m.threshold)


def spread(text: str, rng: np.random.Generator) -> str:
    """HEAD characters of a longer text, in ten pieces from all over it."""
    if len(text) <= HEAD:
        return text
    part, size = len(text) / 10, HEAD // 10
    return " ".join(text[at : at + size] for at in (int(k * part + rng.uniform(0, part - size)) for k in range(10)))


def train(texts: list[str], langs: list[str], seed: int = SEED) -> Model:
    """Trains on four fifths of the rows and calibrates on the rest, on whole texts; in training a text counts with
    HEAD characters from all over it, and once more with a short piece of them, so that short texts are known too."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept, fit = order[: len(order) // 5], order[len(order) // 5 :]
    y = np.array([names.index(x) for x in langs])
    grams: list[np.ndarray] = []
    target: list[int] = []
    for k in fit:
        head = spread(texts[k], rng)
        at = int(rng.integers(0, max(1, len(head) - 60)))
        for piece in (head, head[at : at + int(rng.integers(15, 60))]):
            b = buckets_of(piece)
            if len(b) and has_letter(piece):
                grams.append(b.astype(np.min_scalar_type(BUCKETS - 1)))  # the sample's grams are the driver's largest memory
                target.append(int(y[k]))
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    w, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    steps = EPOCHS * -(-len(grams) // BATCH)
    done = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(grams))
        for at in range(0, len(grams), BATCH):
            rate = RATE * (1 - done / max(1, steps))
            done += 1
            rows = shuffled[at : at + BATCH]
            hidden = np.stack([e[grams[k]].mean(0) for k in rows])
            error = softmax(hidden @ w + bias)
            error[np.arange(len(rows)), [target[k] for k in rows]] -= 1
            back = error @ w.T
            w -= rate * hidden.T @ error / len(rows) * 4
            bias -= rate * error.mean(0)
            for k, g in zip(rows, back):
                where, n = np.unique(grams[k], return_counts=True)
                e[where] -= rate * 8 / len(rows) * np.outer(n / len(grams[k]), g) * len(where) ** 0.5
    m = Model(names, e @ w, bias, 1.0, 0.0)
    rows = [k for k in kept if has_letter(texts[k])]
    if rows:
        z = np.stack([logits(texts[k], m) for k in rows])
        loss = [(-np.log(np.maximum(softmax(z / t)[np.arange(len(rows)), y[rows]], 1e-12)).mean(), t) for t in np.geomspace(0.05, 5, 60)]
        m.temperature = float(min(loss)[1])
        p = softmax(z / m.temperature)
        right = p.max(1)[p.argmax(1) == y[rows]]
        m.threshold = float(np.quantile(right, SLACK)) if len(right) else 0.0
    return m


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The training rows: text and lang of about `size` documents outside fold 2, equally many of each language and one
    at least, by hash of id."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.coalesce(fold(F.col("doc_id")), F.lit(0)) != 2))
    langs = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    per = max(1, size // max(1, langs.count()))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    # hashes are uniform: below this share of them lie three times the rows that are needed, so few rows meet in the sort
    near = rows.select("lang", "text", "doc_id").join(few(langs), "lang").where(h <= F.least(F.lit(1.0), 3 * per / F.col("n")) * (1 << 30))
    near = near.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text"))
    return near.withColumn("place", place).where(F.col("place") <= per).drop("place")


def fitted(docs: DataFrame, size: int = SAMPLE) -> Model:
    rows = sorted((r["lang"], r["h"], r["text"]) for r in sample(docs, size).collect())
    model = train([r[2] for r in rows], [r[0] for r in rows])
    del rows
    trimmed()
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language, score and rejection of every document; no shuffle besides the sample's."""
    m = model or fitted(docs)
    shared = docs.sparkSession.sparkContext.broadcast(m)  # BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        m = shared.value
        for b in batches:
            rows = [predict(t.as_py(), m) for t in b.column(2)]
            lang, score, out = map(list, zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that are not rejected, with their columns as they are."""
    m = model or fitted(docs)
    shared = docs.sparkSession.sparkContext.broadcast(m)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for b in batches:
            yield b.filter(pa.array([not predict(t.as_py(), shared.value)[2] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
