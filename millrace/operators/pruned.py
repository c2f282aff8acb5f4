"""Exact top-k retrieval that scores less: bounds of terms and of blocks, and the three ways of pruning by them.

A posting's gain is its BM25 contribution. `bounds` gives each term its greatest gain (and the k-th greatest, from
which a lower limit of any query's k-th score follows: a document's score is at least each of its gains); `blocks`
gives each term its greatest gain within runs of doc_ids. What can't reach the limit is not scored:

- `wand`: documents whose matching terms' bounds add up to less;
- `maxscore`: documents that hold only terms of a query that together stay below it (the non-essential terms);
- `block_max`: documents of blocks in which the query's terms together stay below it.

All three give the rows of `retrieval.bm25`. As joins, what they save is the sum over postings of pruned documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval as R


def gains(docs: DataFrame, queries: DataFrame, tokens=T.words, k1: float = R.K1, b: float = R.B) -> DataFrame:
    """(term, doc_id, gain) of the postings of query terms: an index's postings with their contributions."""
    size = R.lengths(docs, tokens)
    total = size.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    hit = R.postings(docs, tokens).join(R.query_terms(queries, tokens).select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    rows = hit.join(df, "term").join(size, "doc_id").join(F.broadcast(total))
    gain = R.idf_bm25(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return rows.select("term", "doc_id", gain.alias("gain"))


def bounds(index: DataFrame, k: int = 10) -> DataFrame:
    """(term, df, bound, kth): number of postings, greatest gain, and the k-th greatest (0 if there are fewer)."""
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("gain")))
    kth = index.select("term", "gain", place.alias("place")).where(F.col("place") <= k).groupBy("term").agg(F.max(F.when(F.col("place") == k, F.col("gain"))).alias("kth"))
    by = index.groupBy("term").agg(F.count("*").alias("df"), F.max("gain").alias("bound"))
    return by.join(kth, "term").select("term", "df", "bound", F.coalesce("kth", F.lit(0.0)).alias("kth"))


def blocks(index: DataFrame, size: int = 64) -> DataFrame:
    """(term, block, last, bound): of each run of `size` doc_ids a term's last document and greatest gain."""
    return index.groupBy("term", F.floor(F.col("doc_id") / size).alias("block")).agg(F.max("doc_id").alias("last"), F.max("gain").alias("bound"))


def limits(terms: DataFrame) -> DataFrame:
    """(query_id, limit): at most the k-th best score of a query, less what rounding may take."""
    return terms.groupBy("query_id").agg((F.max("kth") * (1 - 1e-9) - 1e-6).alias("limit"))


def finished(rows: DataFrame, k: int) -> DataFrame:
    """The ranking of (query_id, doc_id, gain) rows."""
    scores = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("gain"), R.PLACES).alias("score"))
    return R.ranked(scores.where("score > 0"), k)


def wand(docs: DataFrame, queries: DataFrame, k: int = 10, tokens=T.words) -> DataFrame:
    index = gains(docs, queries, tokens)
    terms = R.query_terms(queries, tokens).join(bounds(index, k), "term")
    rows = index.join(terms.select("query_id", "term", "bound"), "term").join(limits(terms), "query_id")
    whole = Window.partitionBy("query_id", "doc_id")
    return finished(rows.withColumn("most", F.sum("bound").over(whole)).where("most >= limit"), k)


def maxscore(docs: DataFrame, queries: DataFrame, k: int = 10, tokens=T.words) -> DataFrame:
    index = gains(docs, queries, tokens)
    terms = R.query_terms(queries, tokens).join(bounds(index, k), "term")
    up = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.withColumn("most", F.sum("bound").over(up)).join(limits(terms), "query_id").select("query_id", "term", (F.col("most") >= F.col("limit")).alias("essential"))
    rows = index.join(terms, "term")
    candidates = rows.where("essential").select("query_id", "doc_id").distinct()
    return finished(rows.join(candidates, ["query_id", "doc_id"], "left_semi"), k)


def block_max(docs: DataFrame, queries: DataFrame, k: int = 10, size: int = 64, tokens=T.words) -> DataFrame:
    index = gains(docs, queries, tokens)
    terms = R.query_terms(queries, tokens).join(bounds(index, k), "term")
    open_ = blocks(index, size).select("term", "block", F.col("bound").alias("most")).join(terms.select("query_id", "term"), "term")
    open_ = open_.groupBy("query_id", "block").agg(F.sum("most").alias("most")).join(limits(terms), "query_id").where("most >= limit").select("query_id", "block")
    rows = index.withColumn("block", F.floor(F.col("doc_id") / size)).join(terms.select("query_id", "term"), "term")
    return finished(rows.join(open_, ["query_id", "block"], "left_semi"), k)


def work(docs: DataFrame, queries: DataFrame, k: int = 10, tokens=T.words) -> DataFrame:
    """(query_id, postings, scored): postings of a query's terms, and those of documents that maxscore doesn't prune."""
    index = gains(docs, queries, tokens)
    terms = R.query_terms(queries, tokens).join(bounds(index, k), "term")
    up = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    marked = terms.withColumn("most", F.sum("bound").over(up)).join(limits(terms), "query_id").select("query_id", "term", (F.col("most") >= F.col("limit")).cast("int").alias("essential"))
    by = index.join(marked, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.max("essential").alias("e"))
    return by.groupBy("query_id").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("e") == 1, F.col("n")).otherwise(0)).alias("scored"))
