"""Comparison of structured records leaf by leaf, and chunking of documents into rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import parsing as P


def repaired(rows: DataFrame) -> DataFrame:
    """(id, text) to (id, layer, json): the first layer of repair that reads an object, null where none does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [P.lenient(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "layer": [n for n, _ in found], "json": [None if v is None else P.canonical(v) for _, v in found]})

    return rows.select("id", "text").mapInPandas(run, "id long, layer string, json string")


def flattened(rows: DataFrame, json: str = "json") -> DataFrame:
    """(id, path, value) of each leaf."""
    return rows.select("id", F.explode(P.json_leaves(F.col(json))).alias("l")).select("id", "l.path", "l.value")


def compared(gold: DataFrame, said: DataFrame, match=None) -> DataFrame:
    """Tallies by generic path of two leaf tables (id, path, value): correct, wrong, missing, spurious."""
    both = gold.select("id", "path", F.col("value").alias("g"), F.lit(True).alias("in_g")).join(said.select("id", "path", F.col("value").alias("s"), F.lit(True).alias("in_s")), ["id", "path"], "full")
    same = (match or (lambda g, s: g == s))(F.col("g"), F.col("s"))
    kind = F.when(F.col("in_s").isNull(), "missing").when(F.col("in_g").isNull(), "spurious").when(F.coalesce(same, F.lit(False)), "correct").otherwise("wrong")
    rows = both.select(F.regexp_replace("path", r"\[[0-9]+\]", "[]").alias("path"), kind.alias("kind"))
    return rows.groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("correct", "wrong", "missing", "spurious")])


def micro(tallies: DataFrame) -> DataFrame:
    """Precision, recall and F1 over all leaves; 0 where there is nothing to count."""
    t = tallies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("correct", "wrong", "missing", "spurious")])
    c, w, m, s = (F.col(x) for x in ("correct", "wrong", "missing", "spurious"))
    p, r = F.coalesce(F.try_divide(c, c + w + s), F.lit(0.0)), F.coalesce(F.try_divide(c, c + w + m), F.lit(0.0))
    return t.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def fixed_chunks(docs: DataFrame, size: int = 80, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk_id, start, end, text): windows of `size` words of which each shares `overlap` with the next, the last
    one reaching the end. Column expressions: a text is cut into pieces of a word and the white space before it, so
    windows are runs of pieces and offsets are lengths of runs."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be less than size")
    step = size - overlap
    rows = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"\s*\S+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    last = F.ceil(F.greatest(F.size("w") - size, F.lit(0)) / step).cast("int")
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    run = F.array_join(F.slice("w", F.col("k") * step + 1, size), "")
    before = F.length(F.array_join(F.slice("w", F.lit(1), F.col("k") * step), ""))
    rows = rows.select("doc_id", "k", before.alias("before"), run.alias("run"), F.regexp_replace(run, r"^\s+", "").alias("text"))
    start = F.col("before") + F.length("run") - F.length("text")
    return rows.select("doc_id", F.concat_ws("#", "doc_id", "k").alias("chunk_id"), start.alias("start"), (start + F.length("text")).alias("end"), "text")


def sentence_chunks(docs: DataFrame, size: int = 80) -> DataFrame:
    """(doc_id, chunk_id, start, end, text): whole sentences packed under a budget of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["text"]):
                out += [(d, f"{d}#{k}", i, j, t[i:j]) for k, (i, j) in enumerate(P.sentence_chunks(t, size))]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_id string, start int, end int, text string")
