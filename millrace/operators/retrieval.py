"""Lexical retrieval over (doc_id, text) and (query_id, text): postings, BM25, TF-IDF, fusion, feedback, metrics.

A ranking is rows (query_id, doc_id, score, rank): score rounded to 6 places, ties by doc_id, rank from 1.
Postings are pre-aggregated by (doc, term); query terms are joined on term, so only matching postings move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

K1, B = 1.5, 0.75
PLACES = 6


def postings(docs: DataFrame, tokens=T.words) -> DataFrame:
    """(doc_id, term, tf)."""
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, tokens=T.words) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def lengths(docs: DataFrame, tokens=T.words) -> DataFrame:
    return docs.select("doc_id", F.size(tokens(F.col("text"))).alias("dl"))


def ranked(scores: DataFrame, k: int | None, score: str = "score") -> DataFrame:
    """The first k rows of each query by (-score, doc_id)."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")))
    return out if k is None else out.where(F.col("rank") <= k)


def idf_bm25(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, tokens=T.words, k1: float = K1, b: float = B) -> DataFrame:
    size = lengths(docs, tokens)
    total = size.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    q = query_terms(queries, tokens)
    hit = postings(docs, tokens).join(q.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    rows = hit.join(df, "term").join(q, "term").join(size, "doc_id").join(F.broadcast(total))
    gain = idf_bm25(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    scores = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(gain), PLACES).alias("score"))
    return ranked(scores.where("score > 0"), k)


def tfidf_weights(rows: DataFrame, df: DataFrame, n: DataFrame) -> DataFrame:
    """Adds w = tf * (ln((1 + n) / (1 + df)) + 1) to rows with term and tf; terms that no document has are dropped."""
    return rows.join(df, "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))


def tfidf(docs: DataFrame, queries: DataFrame, k: int | None = 10, tokens=T.words) -> DataFrame:
    p = postings(docs, tokens)
    n = docs.agg(F.count("*").alias("n"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    d = tfidf_weights(p, df, n).select("doc_id", "term", F.col("w").alias("dw"))
    norm = d.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("dw") * F.col("dw"))).alias("dn"))
    q = postings(queries.withColumnRenamed("query_id", "doc_id"), tokens).withColumnRenamed("doc_id", "query_id")
    q = tfidf_weights(q, df, n).select("query_id", "term", F.col("w").alias("qw"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dots = d.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("dw") * F.col("qw")).alias("dot"))
    scores = dots.join(norm, "doc_id").join(qn, "query_id").select("query_id", "doc_id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), PLACES).alias("score"))
    return ranked(scores.where("score > 0"), k)


def rrf(rankings: list[DataFrame], k: int | None = 10, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (c + rank) over the rankings that have a document."""
    rows = None
    for r in rankings:
        part = r.select("query_id", "doc_id", (1 / (c + F.col("rank"))).alias("gain"))
        rows = part if rows is None else rows.unionByName(part)
    return ranked(rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("gain"), 9).alias("score")), k)


def min_max(ranking: DataFrame, name: str) -> DataFrame:
    """Scores of each query scaled to 0..1; 0 where all are equal."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return ranking.select("query_id", "doc_id", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0).alias(name))


def weighted_fusion(a: DataFrame, b: DataFrame, alpha: float = 0.5, k: int | None = 10) -> DataFrame:
    """alpha * scaled a + (1 - alpha) * scaled b; a document that a ranking lacks has 0 there."""
    both = min_max(a, "a").join(min_max(b, "b"), ["query_id", "doc_id"], "full")
    return ranked(both.select("query_id", "doc_id", F.round(alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0)), PLACES).alias("score")), k)


def interleave(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Round robin, a first; of a document's two places the earlier one stays."""
    rows = a.select("query_id", "doc_id", (2 * F.col("rank") - 1).alias("place")).unionByName(b.select("query_id", "doc_id", (2 * F.col("rank")).alias("place")))
    best = rows.groupBy("query_id", "doc_id").agg(F.min("place").alias("place"))
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return out.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")


def feedback_terms(docs: DataFrame, queries: DataFrame, top: DataFrame, k: int = 3, tokens=T.words) -> DataFrame:
    """(query_id, term, weight, place): of each query's best document the k terms of greatest tf * idf that the
    query lacks, ties by term."""
    p = postings(docs, tokens)
    n = docs.agg(F.count("*").alias("n"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    best = top.where("rank = 1").select("query_id", "doc_id")
    rows = tfidf_weights(p.join(best, "doc_id"), df, n).select("query_id", "term", F.round("w", PLACES).alias("weight"))
    rows = rows.join(query_terms(queries, tokens), ["query_id", "term"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "term"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def expanded(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Queries with their feedback terms behind them, in order of place."""
    more = terms.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda t: t["term"]), " ").alias("more"))
    return queries.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "more").alias("text"))


def containment(docs: DataFrame, items: DataFrame, n: int = 5, tokens=T.words) -> DataFrame:
    """(query_id, doc_id, share): the share of an item's shingles that a document has; an equi join on shingles."""
    s = items.select("query_id", tokens(F.col("text")).alias("w")).select("query_id", F.explode(T.shingles(F.col("w"), n)).alias("s"))
    size = s.groupBy("query_id").agg(F.count("*").alias("size"))
    d = docs.select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.explode(T.shingles(F.col("w"), n)).alias("s")).join(s.select("s").distinct(), "s", "left_semi")
    both = d.join(s, "s").groupBy("query_id", "doc_id").agg(F.count("*").alias("common"))
    return both.join(size, "query_id").select("query_id", "doc_id", F.round(F.col("common") / F.col("size"), PLACES).alias("share"))


def query_metrics(ranking: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, rr) of every query that has relevant documents."""
    hits = ranking.where(F.col("rank") <= k).join(relevant.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    size = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    return size.join(hits, "query_id", "left").select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), PLACES).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), PLACES).alias("rr"))


def head_to_head(a: DataFrame, b: DataFrame) -> DataFrame:
    """Wins, losses and ties of a against b in reciprocal rank."""
    rows = a.select("query_id", F.col("rr").alias("a")).join(b.select("query_id", F.col("rr").alias("b")), "query_id")
    return rows.agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))


def query_work(docs: DataFrame, queries: DataFrame, tokens=T.words) -> DataFrame:
    """Postings touched and candidates of each query, and the share of its commonest term's postings."""
    q = query_terms(queries, tokens)
    hit = postings(docs, tokens).join(q, "term")
    by = hit.groupBy("query_id", "term").agg(F.count("*").alias("df")).groupBy("query_id").agg(F.sum("df").alias("touched"), F.max("df").alias("head"))
    return by.join(hit.groupBy("query_id").agg(F.countDistinct("doc_id").alias("candidates")), "query_id").select("query_id", "touched", "candidates", F.round(F.col("head") / F.col("touched"), PLACES).alias("head_share"))
