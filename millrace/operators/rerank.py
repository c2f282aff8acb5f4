"""Dense retrieval by latent semantic analysis, second-stage scorers, reranking of shortlists, query rewriting.

A scorer is a function (shortlist, docs, queries) to (query_id, doc_id, value). Latent semantic analysis weighs terms
by (1 + ln tf) * idf, normalises documents, and takes the leading eigenvectors of the terms' Gram matrix, which is
the sum over documents of outer products: each task adds up its own, so what moves is a matrix for each task, whose
size is fixed by the number of terms. Those are the `terms` most documents hold, a parameter of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval as R

TERMS, DIMENSIONS = 512, 64


@dataclass
class TermSpace:
    """Terms with their idf and their vectors: rows of the eigenvector matrix, as they are and of unit length."""

    terms: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    unit: np.ndarray

    def dense(self, words: list[str]) -> np.ndarray:
        """The vector of a list of words; zeros without known ones."""
        at = {t: k for k, t in enumerate(self.terms)}
        found = [at[w] for w in words if w in at]
        if not found:
            return np.zeros(self.vectors.shape[1])
        k, n = np.unique(found, return_counts=True)
        w = (1 + np.log(n)) * self.idf[k]
        return (w / np.linalg.norm(w)) @ self.vectors[k]


def term_space(docs: DataFrame, terms: int = TERMS, dimensions: int = DIMENSIONS, tokens=T.words) -> TermSpace:
    p = R.postings(docs, tokens)
    n = docs.count()
    top = p.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(terms).collect()
    names = [r["term"] for r in top]
    idf = np.log((1 + n) / (1 + np.array([r["df"] for r in top], float))) + 1
    at = {t: k for k, t in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((len(names), len(names)))
        for b in batches:
            for words in b.column(0):
                k, c = np.unique([at[w] for w in words.as_py() or [] if w in at], return_counts=True)
                if len(k):
                    k = k.astype(int)
                    w = (1 + np.log(c)) * idf[k]
                    w /= np.linalg.norm(w)
                    gram[np.ix_(k, k)] += np.outer(w, w)
        i, j = np.nonzero(gram)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(gram[i, j], pa.float64())], names=["i", "j", "v"])

    cells = docs.select(tokens(F.col("text")).alias("w")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    gram = np.zeros((len(names), len(names)))
    gram[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    _, vectors = np.linalg.eigh((gram + gram.T) / 2)
    vectors = vectors[:, ::-1][:, :dimensions]
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return TermSpace(names, idf, vectors, vectors / np.where(size > 0, size, 1))


def embedded(rows: DataFrame, space: TermSpace, key: str, tokens=T.words) -> DataFrame:
    """(key, embedding): the texts' vectors, of unit length."""
    shared = rows.sparkSession.sparkContext.broadcast(space)  # terms x dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([shared.value.dense(w.as_py() or []) for w in b.column(1)]).reshape(b.num_rows, -1)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((x / np.where(size > 0, size, 1)).tolist(), pa.list_(pa.float64()))], names=[key, "embedding"])

    return rows.select(key, tokens(F.col("text")).alias("w")).mapInArrow(run, f"{key} long, embedding array<double>")


def cosine(a: Column, b: Column) -> Column:
    """Of vectors of unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def lsa(docs: DataFrame, queries: DataFrame, k: int = 10, space: TermSpace | None = None) -> DataFrame:
    """The ranking by cosine in the latent space; ties by doc_id. Unit vectors' nearest ones are those of greatest cosine."""
    from millrace.operators import vectors as V

    space = space or term_space(docs)
    d = embedded(docs, space, "doc_id").withColumnRenamed("doc_id", "vec_id")
    q = embedded(queries, space, "query_id")
    near = V.exact_knn(d, q, k)
    return near.select("query_id", F.col("vec_id").alias("doc_id"), F.round(1 - F.col("distance") / 2, 5).alias("score"), "rank")


def reranked(shortlist: DataFrame, values: DataFrame, depth: int) -> DataFrame:
    """(query_id, doc_id, rank): the first `depth` of a ranking in order of a second score, of equal ones as they were;
    the rest behind them."""
    rows = shortlist.join(values.select("query_id", "doc_id", "value"), ["query_id", "doc_id"], "left")
    inside = F.col("rank") <= depth
    order = Window.partitionBy("query_id").orderBy((~inside).cast("int"), F.when(inside, -F.coalesce("value", F.lit(0.0))), "rank")
    return rows.withColumn("place", F.row_number().over(order)).select("query_id", "doc_id", F.col("place").alias("rank"))


def bm25_values(shortlist: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 of the shortlisted documents alone, with the corpus' statistics."""
    return R.bm25(docs, queries, None).join(shortlist.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", F.col("score").alias("value"))


def oracle_values(shortlist: DataFrame, relevant: DataFrame) -> DataFrame:
    """1 for what is relevant: the best that reranking can do."""
    return shortlist.select("query_id", "doc_id").join(relevant.select("query_id", "doc_id", F.lit(1.0).alias("hit")), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("hit", F.lit(0.0)).alias("value"))


def pooled_values(shortlist: DataFrame, docs: DataFrame, queries: DataFrame, space: TermSpace) -> DataFrame:
    """Cosine of the pooled vectors, of candidates only."""
    d = embedded(docs.join(shortlist.select("doc_id").distinct(), "doc_id", "left_semi"), space, "doc_id").withColumnRenamed("embedding", "x")
    q = embedded(queries, space, "query_id").withColumnRenamed("embedding", "y")
    return shortlist.select("query_id", "doc_id").join(d, "doc_id").join(q, "query_id").select("query_id", "doc_id", F.round(cosine(F.col("x"), F.col("y")), 9).alias("value"))


def maxsim_values(shortlist: DataFrame, docs: DataFrame, queries: DataFrame, space: TermSpace, tokens=T.words) -> DataFrame:
    """Sum over a query's known terms of the greatest cosine to a term of the document."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: k for k, t in enumerate(shared.value.terms)}
        known = lambda words: shared.value.unit[[at[w] for w in dict.fromkeys(words.as_py() or []) if w in at]]
        for b in batches:
            out = []
            for q, d in zip(b.column(2), b.column(3)):
                q, d = known(q), known(d)
                out.append(round(float((q @ d.T).max(1).sum()), 9) if len(q) and len(d) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["query_id", "doc_id", "value"])

    rows = shortlist.select("query_id", "doc_id").join(queries.select("query_id", tokens(F.col("text")).alias("q")), "query_id").join(docs.select("doc_id", tokens(F.col("text")).alias("d")), "doc_id")
    return rows.select("query_id", "doc_id", "q", "d").mapInArrow(run, "query_id long, doc_id long, value double")


def moved(before: DataFrame, after: DataFrame, relevant: DataFrame) -> DataFrame:
    """(n, promoted, demoted, same): queries whose first relevant document rose, fell or kept its rank."""
    first = lambda r, name: r.join(relevant.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias(name))
    both = first(before, "x").join(first(after, "y"), "query_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("y") < F.col("x")).alias("promoted"), F.count_if(F.col("y") > F.col("x")).alias("demoted"), F.count_if(F.col("y") == F.col("x")).alias("same"))


def ceiling(values: DataFrame, top: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(query_id, hits): how many candidates reach a query's ceiling (query_id, ceiling), within a tolerance."""
    rows = values.join(top, "query_id")
    return rows.groupBy("query_id").agg(F.count_if(F.abs(F.col("value") - F.col("ceiling")) <= tolerance).alias("hits"))


def hypothetical(queries: DataFrame, texts: DataFrame, append: bool = True) -> DataFrame:
    """Queries with a hypothetical answer (query_id, answer) behind them, or in their place; those without one stay."""
    rows = queries.join(texts.select("query_id", "answer"), "query_id", "left")
    text = F.concat_ws(" ", "text", "answer") if append else F.coalesce("answer", "text")
    return rows.select("query_id", text.alias("text"))


def failing(texts: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Hypothetical answers of which exactly round(rate * n) are lost, in an order given by a hash: what a rate loses, a
    higher one loses too."""
    place = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("query_id").cast("string")).cast("binary")), "query_id"))
    n = texts.agg(F.round(F.lit(rate) * F.count("*")).alias("lost"))
    return texts.withColumn("place", place).join(F.broadcast(n)).select("query_id", F.when(F.col("place") > F.col("lost"), F.col("answer")).alias("answer"))


def iterative(docs: DataFrame, queries: DataFrame, k: int = 10, terms: int = 3) -> DataFrame:
    """Two hops: search, take bridge terms from the best document, search with them, and interleave both rankings."""
    first = R.bm25(docs, queries, k)
    second = R.bm25(docs, R.expanded(queries, R.feedback_terms(docs, queries, first, terms)), k)
    return R.interleave(first, second, k)


def hops(ranking: DataFrame, relevant: DataFrame, bridge: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rr, hit1, hit5, pair5): reciprocal rank of the answer, whether it is in the first 1 and 5, and whether
    the bridge document (query_id, doc_id) is there too."""
    a = ranking.join(relevant.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("a"))
    b = ranking.join(bridge.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("b"))
    rows = relevant.select("query_id").distinct().join(a, "query_id", "left").join(b, "query_id", "left")
    within = lambda c, n: F.coalesce(F.col(c) <= n, F.lit(False))
    rr = F.round(F.when(within("a", k), 1 / F.col("a")).otherwise(0.0), 6)
    return rows.select("query_id", rr.alias("rr"), within("a", 1).alias("hit1"), within("a", 5).alias("hit5"), (within("a", 5) & within("b", 5)).alias("pair5"))


def float_rerank(vectors: DataFrame, queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of distinct candidates (query_id, vec_id) by exact squared distance."""
    rows = candidates.select("query_id", "vec_id").distinct().join(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "vec_id")
    rows = rows.join(queries.select("query_id", F.col("embedding").cast("array<double>").alias("y")), "query_id")
    square = F.aggregate(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    rows = rows.select("query_id", "vec_id", F.round(square, 5).alias("distance"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def search_with_rerank(vectors: DataFrame, decoded: DataFrame, queries: DataFrame, k: int = 10, wide: int = 40) -> DataFrame:
    """The first `wide` by quantised vectors, of which the k nearest by the vectors themselves."""
    from millrace.operators import vectors as V

    return float_rerank(vectors, queries, V.exact_knn(decoded, queries, wide), k)
