"""Small trained models: byte-pair merges learned from word counts, softmax regression, temperature."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = r" ?\S+|\s+(?!\S)|\s+"


def piece_counts(docs: DataFrame) -> DataFrame:
    """(piece, n): the distinct pieces of a lossless split, counted before anything leaves a task."""
    return docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({PIECES})"), F.lit(1))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def learn_merges(pieces: list[tuple[str, int]], merges: int) -> list[tuple[int, int]]:
    """Merges of byte-pair encoding: the pair of greatest count, ties to the least pair, until a count is under two.
    Pair counts are kept up to date; only words that hold the merged pair are looked at again."""
    words = [list(p.encode()) for p, _ in pieces]
    weight = [n for _, n in pieces]
    counts: Counter = Counter()
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, w in enumerate(words):
        for pair in zip(w, w[1:]):
            counts[pair] += weight[k]
            where[pair].add(k)
    out: list[tuple[int, int]] = []
    while len(out) < merges and counts:
        best, n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        if n < 2:
            break
        new = 256 + len(out)
        out.append(best)
        for k in where.pop(best, ()):
            w = words[k]
            for pair in zip(w, w[1:]):
                counts[pair] -= weight[k]
                if counts[pair] <= 0:
                    del counts[pair]
            merged, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and (w[i], w[i + 1]) == best:
                    merged.append(new)
                    i += 2
                else:
                    merged.append(w[i])
                    i += 1
            words[k] = merged
            for pair in zip(merged, merged[1:]):
                counts[pair] += weight[k]
                where[pair].add(k)
    return out


class ByteBpe:
    """Encoder and decoder of a merge list; a prefix of the list is a smaller vocabulary."""

    def __init__(self, merges: list[tuple[int, int]]):
        self.merges = merges
        self.rank = {m: k for k, m in enumerate(merges)}
        self.bytes = [bytes([b]) for b in range(256)]
        for a, b in merges:
            self.bytes.append(self.bytes[a] + self.bytes[b])
        self.memo: dict[str, list[int]] = {}

    def truncated(self, merges: int) -> ByteBpe:
        return ByteBpe(self.merges[:merges])

    def piece(self, text: str) -> list[int]:
        if text not in self.memo:
            w = list(text.encode())
            while len(w) > 1:
                rank, at = min((self.rank.get(p, len(self.merges)), i) for i, p in enumerate(zip(w, w[1:])))
                if rank == len(self.merges):
                    break
                w[at : at + 2] = [256 + rank]
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[text] = w
        return self.memo[text]

    def encode(self, text: str | None) -> list[int]:
        import re

        return [i for p in re.findall(PIECES, text or "") for i in self.piece(p)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


def compression(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, n_bytes, n_tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len((t or "").encode()) for t in b["text"]], "n_tokens": [len(bpe.encode(t)) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_softmax(rows: DataFrame, features: str, label: str, classes: int, dim: int, steps: int = 50, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights (dim + 1, classes) of multinomial regression by full-batch gradient descent from zero. Each step is one
    distributed sum of gradients of fixed size; the rows stay where they are."""
    w = np.zeros((dim + 1, classes))
    rows = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")).cache()
    n = rows.count()
    for _ in range(steps if n else 0):

        def run(batches: Iterator[pd.DataFrame], w=w) -> Iterator[pd.DataFrame]:
            g = np.zeros_like(w)
            for b in batches:
                if len(b):
                    x = np.hstack([np.stack(b["x"].to_numpy()), np.ones((len(b), 1))])
                    p = softmax(x @ w)
                    p[np.arange(len(b)), b["y"].to_numpy()] -= 1
                    g += x.T @ p
            yield pd.DataFrame({"i": np.arange(g.size), "g": g.ravel()})

        g = rows.mapInPandas(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy().reshape(w.shape)
        penalty = decay * np.vstack([w[:-1], np.zeros((1, classes))])
        w = w - rate * (g / n + penalty)
    rows.unpersist()
    return w


def fit_temperature(logits: np.ndarray, labels: np.ndarray, low: float = 0.05, high: float = 20.0, rounds: int = 80) -> float:
    """Temperature of least negative log-likelihood, by golden section on its inverse."""
    ratio = (5**0.5 - 1) / 2

    def loss(b: float) -> float:
        p = softmax(logits * b)[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    a, c = 1 / high, 1 / low
    x, y = c - ratio * (c - a), a + ratio * (c - a)
    fx, fy = loss(x), loss(y)
    for _ in range(rounds):
        if fx <= fy:
            c, y, fy = y, x, fx
            x = c - ratio * (c - a)
            fx = loss(x)
        else:
            a, x, fx = x, y, fy
            y = a + ratio * (c - a)
            fy = loss(y)
    return 2 / (a + c)
