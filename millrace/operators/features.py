"""Hashed text features with cosine, word tokenisers, vocabularies, and a semantic cache as a fold over requests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

BITS = 20


def grams(text: Column, kind: str) -> Column:
    """Feature strings: `word` gives w:word and b:word word, `char` gives c: and each three characters of the text with a
    blank on both sides."""
    if kind == "word":
        w = T.words(text)
        pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.lit("b:"), F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(w, lambda x: F.concat(F.lit("w:"), x)), pairs)
    padded = F.concat(F.lit(" "), T.squashed(text), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.concat(F.lit("c:"), F.substring(padded, i, 3)))


def vectors(rows: DataFrame, key: str, kind: str = "word", bits: int = BITS) -> DataFrame:
    """(key, bucket, w): counts of hashed features, each text's of length 1."""
    g = rows.select(key, F.explode(grams(F.col("text"), kind)).alias("g"))
    n = g.groupBy(key, T.fnv1a(F.col("g")).bitwiseAND((1 << bits) - 1).alias("bucket")).agg(F.count("*").alias("n"))
    size = n.groupBy(key).agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("size"))
    return n.join(size, key).select(key, "bucket", (F.col("n") / F.col("size")).alias("w"))


def cosines(pairs: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """pairs (a, b) with cosine, 0 where they share nothing: a join on buckets of the pairs alone."""
    x = pairs.join(a.withColumnRenamed(key, "a").withColumnRenamed("w", "x"), "a")
    dots = x.join(b.withColumnRenamed(key, "b").withColumnRenamed("w", "y"), ["b", "bucket"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.round(F.coalesce("dot", F.lit(0.0)), 6).alias("cosine"))


def word_vocabulary(docs: DataFrame, size: int, pattern: str = r"\S+") -> DataFrame:
    """(word, id): the size - 1 most frequent words by (-count, word), from id 1 on; 0 stands for all others."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size - 1)
    from pyspark.sql import Window

    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "word"))).select("word", "id")  # size - 1 rows


def unknown_words(docs: DataFrame, vocabulary: DataFrame, pattern: str = r"\S+") -> DataFrame:
    """(words, unknown, rate) of texts under a vocabulary."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    t = words.join(vocabulary.select("word", F.lit(1).alias("known")), "word", "left").agg(F.sum("n").alias("words"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))
    return t.select("words", "unknown", F.round(F.coalesce(F.try_divide("unknown", "words"), F.lit(0.0)), 6).alias("rate"))


def unseen_characters(train: DataFrame, other: DataFrame) -> DataFrame:
    """(c): characters of the other texts that the training texts lack."""
    chars = lambda t: t.select(F.explode(F.split("text", "")).alias("c")).where("c != ''").distinct()
    return chars(other).join(chars(train), "c", "left_anti")


def vocabulary(docs: DataFrame, tokens=T.words) -> DataFrame:
    """(term, id): all terms in order, ids from 0; numbered over range partitions."""
    from millrace.operators.stats import running

    terms = docs.select(F.explode(tokens(F.col("text"))).alias("term")).distinct().withColumn("one", F.lit(1).cast("long"))
    return running(terms, ["term"], {"one": "upto"}).select("term", (F.col("upto") - 1).alias("id"))


def vectorized(docs: DataFrame, terms: DataFrame, tokens=T.words) -> DataFrame:
    """(doc_id, id, n): counts of known terms; others are left out."""
    t = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return t.join(terms, "term").select("doc_id", "id", "n")


class SemanticCache:
    """Answers by exact text, else by the nearest entry: a cosine of at least `threshold`, the earliest of equal ones, and at
    least `margin` above the best entry of another answer; else it pays and inserts."""

    def __init__(self, threshold: float, margin: float = 0.0):
        self.threshold, self.margin = threshold, margin
        self.exact: dict[str, object] = {}
        self.rows: list[dict[int, float]] = []
        self.answers: list[object] = []

    @staticmethod
    def vector(text: str) -> dict[int, float]:
        words = re.findall(r"[^\W_]+", text.lower())
        out: dict[int, float] = {}
        for g in [f"w:{w}" for w in words] + [f"b:{a} {b}" for a, b in zip(words, words[1:])]:
            h = 2166136261
            for unit in np.frombuffer(g.encode("utf-16-le"), "<u2").tolist():
                h = (h ^ unit) * 16777619 & 0xFFFFFFFF
            out[h % (1 << BITS)] = out.get(h % (1 << BITS), 0.0) + 1
        size = sum(x * x for x in out.values()) ** 0.5
        return {k: x / size for k, x in out.items()} if size else out

    def lookup(self, text: str) -> tuple[str, object, float]:
        """(exact, near or miss; the answer; the best cosine)."""
        if text in self.exact:
            return "exact", self.exact[text], 1.0
        v = self.vector(text)
        scores = [sum(x * r[k] for k, x in v.items() if k in r) for r in self.rows]
        if not scores:
            return "miss", None, 0.0
        best = max(range(len(scores)), key=lambda k: (scores[k], -k))
        rival = max((s for s, a in zip(scores, self.answers) if a != self.answers[best]), default=0.0)
        if scores[best] >= self.threshold and scores[best] - rival >= self.margin:
            return "near", self.answers[best], scores[best]
        return "miss", None, scores[best]

    def insert(self, text: str, answer) -> None:
        if text not in self.exact:
            self.exact[text] = answer
            self.rows.append(self.vector(text))
            self.answers.append(answer)


def replayed(requests: DataFrame, threshold: float, margin: float = 0.0) -> DataFrame:
    """(part, id, outcome, wrong, cosine) of requests (part, id, intent, text): each part has a cache of its own, which
    sees its requests in order of id. A cache grows with its distinct texts, so parts are how it scales."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cache, out = SemanticCache(threshold, margin), []
        for r in rows.sort_values("id").itertuples():
            kind, answer, score = cache.lookup(r.text)
            if kind == "miss":
                cache.insert(r.text, r.intent)
            out.append((r.part, r.id, kind, kind != "miss" and answer != r.intent, round(score, 6)))
        return pd.DataFrame(out, columns=["part", "id", "outcome", "wrong", "cosine"])

    return requests.select("part", "id", "intent", "text").groupBy("part").applyInPandas(run, "part long, id long, outcome string, wrong boolean, cosine double")


def replay_totals(rows: DataFrame, price: float = 0.01) -> DataFrame:
    """(n, exact, near, misses, wrong, cost, uncached): what a replay served and paid, and what it would cost without."""
    t = rows.agg(
        F.count("*").alias("n"), F.count_if(F.expr("outcome = 'exact'")).alias("exact"), F.count_if(F.expr("outcome = 'near'")).alias("near"),
        F.count_if(F.expr("outcome = 'miss'")).alias("misses"), F.count_if(F.expr("wrong")).alias("wrong"),
    )
    return t.select("*", F.round(F.col("misses") * price, 6).alias("cost"), F.round(F.col("n") * price, 6).alias("uncached"))


def swept(requests: DataFrame, thresholds: list[float], margins: list[float]) -> Iterator[tuple[float, float, DataFrame]]:
    """Replays over a grid of thresholds and margins."""
    for t in thresholds:
        for m in margins:
            yield t, m, replay_totals(replayed(requests, t, m))
