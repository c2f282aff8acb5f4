"""Vectors: exact search in blocks, quantisation, recall. Vectors are array<float> columns; distances are in double."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 5
BLOCK = 1 << 11  #: rows whose distances to the queries are held at a time


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 1 << 12) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest by squared distance, ties by vec_id.

    vectors: (vec_id, embedding), queries: (query_id, embedding). Queries are packed into blocks of
    query_block rows; every block meets every partition of vectors, which keeps k rows a query; so what is
    shuffled is k rows for each query and partition, whatever the number of vectors.
    """
    packed = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("query_id"), F.lit(64)).alias("g"))
    place = F.floor((F.row_number().over(Window.partitionBy("g").orderBy("query_id")) - 1) / query_block)
    blocks = packed.withColumn("b", place).groupBy("g", "b").agg(F.collect_list(F.struct("query_id", "embedding")).alias("q"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.spark_partition_id().alias("p"))
    chunks = rows.withColumn("c", F.floor((F.row_number().over(Window.partitionBy("p").orderBy("vec_id")) - 1) / BLOCK))
    chunks = chunks.groupBy("p", "c").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, v in zip(b.column(0), b.column(1)):
                (qid, x), (vid, y) = matrix(q.values), matrix(v.values)
                d = np.round(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0), PLACES)
                near = d <= np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1, None]  # ties and all
                i, j = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(vid[j]), pa.array(d[i, j])], names=["query_id", "vec_id", "distance"])

    near = blocks.select("q").join(chunks.select("v")).mapInArrow(run, "query_id long, vec_id long, distance double")
    near = near.withColumn("distance", F.round("distance", PLACES))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of an array of structs of both."""
    x = rows.field(1)
    return rows.field(0).to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def peak(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))


def int8(vectors: DataFrame) -> DataFrame:
    """(vec_id, scale, codes): scale is the greatest magnitude / 127, codes are rounded half to even; zeros have scale 0."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("scale", peak(F.col("v")) / 127)
    code = lambda x: F.when(F.col("scale") > 0, F.rint(x / F.col("scale"))).otherwise(0.0).cast("int")
    return v.select("vec_id", "scale", F.transform("v", lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), code(x)))).alias("codes"))


def int8_decoded(codes: DataFrame) -> DataFrame:
    return codes.select("vec_id", F.transform("codes", lambda c: c * F.col("scale")).alias("embedding"))


def grid(vectors: DataFrame, levels: int = 256, clip: float = 0.0) -> DataFrame:
    """(dim, lo, step): a uniform grid for each dimension, from least to greatest value or from the quantile `clip` to 1 - clip."""
    cells = vectors.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    lo, hi = (F.percentile("x", clip), F.percentile("x", 1 - clip)) if clip else (F.min("x"), F.max("x"))
    return cells.groupBy("dim").agg(lo.alias("lo"), ((hi - lo) / (levels - 1)).alias("step"))


def grid_decoded(codes: DataFrame, fitted: DataFrame) -> DataFrame:
    """(vec_id, embedding) of codes (vec_id, codes) by a fitted grid."""
    g = F.broadcast(fitted.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "step"))).alias("g")))
    return codes.join(g).select("vec_id", F.zip_with("codes", "g", lambda c, x: x["lo"] + c * x["step"]).alias("embedding"))


def with_rogues(vectors: DataFrame, n: int, scale: float, dim: int) -> DataFrame:
    """vectors and n more of ids below 0, far out in turn along each dimension."""
    far = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.when(F.pmod(F.col("id"), F.lit(dim)) == k, F.lit(float(scale))).otherwise(0.0))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(vectors.sparkSession.range(n).select((-1 - F.col("id")).alias("vec_id"), far.alias("embedding")))


def total_bytes(scheme: str, n: int, dim: int) -> int:
    """Bytes that n vectors take: float32; int8 with a scale each; int8 or packed int4 codes with a grid."""
    return {"float32": 4 * n * dim, "int8": n * dim + 4 * n, "grid8": n * dim + 8 * dim, "grid4": n * -(-dim // 2) + 8 * dim}[scheme]


def grid_codes(vectors: DataFrame, levels: int = 256, fitted: DataFrame | None = None) -> DataFrame:
    """(vec_id, codes): grid places, clipped; a constant dimension has code 0. The grid has a row a dimension."""
    fitted = grid(vectors, levels) if fitted is None else fitted
    g = F.broadcast(fitted.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "step"))).alias("g")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).join(g)
    code = lambda x, c: F.when(c["step"] > 0, F.rint((x - c["lo"]) / c["step"])).otherwise(0.0)
    return rows.select("vec_id", F.zip_with("v", "g", lambda x, c: F.greatest(F.lit(0), F.least(F.lit(levels - 1), code(x, c).cast("int")))).alias("codes"))


def packed(codes: Column) -> Column:
    """Two 4-bit codes a byte, the first one low."""
    n = F.size(codes)
    pairs = F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, F.transform(pairs, lambda i: codes[2 * i] + 16 * F.coalesce(F.get(codes, 2 * i + 1), F.lit(0)))).otherwise(F.array().cast("array<int>"))


def unpacked(pairs: Column, n: Column) -> Column:
    return F.slice(F.flatten(F.transform(pairs, lambda b: F.array(b % 16, F.floor(b / 16).cast("int")))), 1, n)


def rmse(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vec_id, rmse) of two versions of the vectors."""
    both = a.select("vec_id", F.col("embedding").alias("a")).join(b.select("vec_id", F.col("embedding").alias("b")), "vec_id")
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return both.select("vec_id", F.round(F.sqrt(square / F.size("a")), 6).alias("rmse"))


def recall(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall): the share of the true k that were found."""
    t = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    hit = t.join(found.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("recall"))
