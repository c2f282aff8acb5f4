"""Sketches of shingle sets in SQL: MinHash, SimHash, banding, exact similarity, scores of pair sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.stats import kept

P = (1 << 61) - 1
GROUP = 256  #: sets whose bits are counted together


def shingle_sets(docs: DataFrame, n: int = 5, tokens=T.words) -> DataFrame:
    """(doc_id, s): 60-bit hashes of the distinct shingles, in one array; texts without words are left out."""
    w = docs.select("doc_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)  # a filter on s would be computed on its own, below
    return w.select("doc_id", F.array_distinct(F.transform(T.shingles(F.col("w"), n), T.hash60)).alias("s"))


def exploded(sets: DataFrame) -> DataFrame:
    return sets.select("doc_id", F.explode("s").alias("s"))


def coefficients(k: int) -> list[tuple[int, int]]:
    """Fixed by a rule, so that SQL can have them too: a = 2i+1 times a prime, b = i times another."""
    return [((2 * i + 1) * 1_000_003 % P, (i + 1) * 998_244_353 % P) for i in range(k)]


def minhash(sets: DataFrame, k: int = 16) -> DataFrame:
    """(doc_id, h0..): the minima of (a * s + b) mod 2^61 - 1 over each set, where it is: no shuffle."""
    # a < 2^27 and s < 2^60, so in two halves of s nothing exceeds 63 bits; times 2^30 is a rotation of 61 bits
    long = lambda x: F.lit(x).cast("long")
    turned = lambda x: F.shiftright(x, 31) + F.shiftleft(x.bitwiseAND((1 << 31) - 1), 30)
    value = lambda x, a, b: (turned(F.shiftright(x, 30) * long(a)) + x.bitwiseAND((1 << 30) - 1) * long(a) + long(b)) % long(P)
    least = lambda a, b: F.array_min(F.transform("s", lambda x: value(x, a, b)))
    return sets.select("doc_id", *[least(a, b).alias(f"h{i}") for i, (a, b) in enumerate(coefficients(k))])


def bands(signatures: DataFrame, k: int, r: int) -> DataFrame:
    """(doc_id, key) of each band of r rows."""
    keys = [F.concat_ws(":", F.lit(str(b)), *[F.col(f"h{i}") for i in range(b * r, b * r + r)]) for b in range(k // r)]
    return signatures.select("doc_id", F.explode(F.array(*keys)).alias("key"))


def candidates(signatures: DataFrame, k: int = 16, r: int = 4) -> DataFrame:
    """(a, b) of all documents that agree in a band, a < b."""
    rows = bands(signatures, k, r)
    return rows.withColumnRenamed("doc_id", "a").join(rows.withColumnRenamed("doc_id", "b"), "key").where("a < b").select("a", "b").distinct()


def similar_pairs(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, jaccard) of all documents of similarity `least`, exact. Sets that are so similar share one of their
    rarest n - ceil(least * n) + 1 shingles, so a join on those finds every pair. What one set alone has comes first in
    that order and joins with nothing, so only shingles that several sets have go on."""
    t = least - 5e-7  # similarities are rounded
    rows = sets.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("s"))
    shared = rows.withColumn("df", F.count("*").over(Window.partitionBy("s"))).where("df > 1")
    by = Window.partitionBy("doc_id")
    place = F.row_number().over(by.orderBy("df", "s")) + F.col("n") - F.count("*").over(by)
    rare = shared.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(t * F.col("n")) + 1)
    x, y = rare.select("s", F.col("doc_id").alias("a"), F.col("n").alias("na")), rare.select("s", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    pairs = x.join(y, "s").where("a < b").where(F.least("na", "nb") >= t * F.greatest("na", "nb")).select("a", "b").distinct()
    return similarities(pairs, sets).where(F.col("jaccard") >= least)


def classes(sets: DataFrame) -> DataFrame:
    """(doc_id, s, m): one of the documents of each set, its sorted set, and how many documents have it. Rows of one
    doc_id are one set; those without doc_id pair with nothing. Sets are told apart by size and two 64-bit hashes."""
    whole = sets.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    keys = [F.size("s").alias("n"), F.xxhash64("s").alias("p"), F.xxhash64(F.lit(1), "s").alias("q")]
    whole = kept(whole.select("doc_id", "s", *keys))
    of = whole.groupBy("n", "p", "q").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("m"))
    return kept(whole.select("doc_id", "s").join(of.select("doc_id", "m"), "doc_id"))


def candidate_scores(sets: DataFrame, k: int = 16, r: int = 4, least: float = 0.8) -> DataFrame:
    """pair_scores(candidates(minhash(sets, k), k, r), similar_pairs(sets, least)) without writing the candidates down:
    equal sets are one class of weight m, of which all pairs are similar candidates; the pairs that agree in a band are
    counted by inclusion and exclusion over groups of equal bands; only similar pairs of classes are looked at."""
    reps = classes(sets)
    b = k // r
    signed = kept(minhash(reps, k).join(reps.select("doc_id", "m"), "doc_id"))
    bands = signed.select("doc_id", "m", *[F.struct(*[F.col(f"h{i}") for i in range(j * r, j * r + r)]).alias(f"b{j}") for j in range(b)])
    pairs_of = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("decimal(38,0)")
    n = F.col("n").cast("decimal(19,0)")
    said = None
    for size in range(1, b + 1):
        for some in combinations([f"b{j}" for j in range(b)], size):
            part = bands.groupBy(*some).agg(F.sum("m").alias("n")).agg((pairs_of(n) * (-1) ** (size + 1)).alias("said"))
            said = part if said is None else said.unionByName(part)
    x, y = (bands.select(F.col("doc_id").alias(i), F.col("m").alias(f"m{i}"), *[F.col(f"b{j}").alias(f"{i}{j}") for j in range(b)]) for i in "ab")
    found = similar_pairs(reps, least).select("a", "b").join(x, "a").join(y, "b")
    agree = reduce(or_, [F.col(f"a{j}") == F.col(f"b{j}") for j in range(b)])
    weight = F.col("ma") * F.col("mb")
    between = found.agg(F.coalesce(F.sum(F.when(agree, weight)), F.lit(0)).alias("hit"), F.coalesce(F.sum(weight), F.lit(0)).alias("all"))
    within = reps.agg(pairs_of(F.col("m").cast("decimal(19,0)")).cast("long").alias("same"))
    t = said.agg(F.sum("said").cast("long").alias("said")).join(between).join(within)
    tp = F.col("hit") + F.col("same")
    return scored(t.select(tp.alias("tp"), (F.col("said") - tp).alias("fp"), (F.col("all") - F.col("hit")).alias("fn")))


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, jaccard) of given pairs, exact: the sets of the pairs' documents meet."""
    rows = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    rows = rows.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("c"))
    return rows.select("a", "b", F.round(F.col("c") / (F.col("n") - F.col("c")), 6).alias("jaccard"))


def estimates(pairs: DataFrame, signatures: DataFrame, k: int = 16) -> DataFrame:
    """(a, b, estimate): the share of equal components."""
    x, y = signatures.alias("x"), signatures.alias("y")
    rows = pairs.join(x, F.col("a") == F.col("x.doc_id")).join(y, F.col("b") == F.col("y.doc_id"))
    same = sum((F.col(f"x.h{i}") == F.col(f"y.h{i}")).cast("int") for i in range(k))
    return rows.select("a", "b", F.round(same / k, 6).alias("estimate"))


def simhash(sets: DataFrame, bits: int = 60) -> DataFrame:
    """(doc_id, simhash): a bit is set if more of the set's hashes have it than lack it. Rows of one doc_id are one set.

    Votes are counted a batch of arrays at a time: as rows, or as lambdas, each hash would cost `bits` evaluations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at in range(0, b.num_rows, GROUP):
                part = b.column(1).slice(at, GROUP)
                ends, s = np.asarray(part.offsets).astype(np.int64), np.asarray(part.values)
                n = np.diff(ends)
                s, full, code = s[ends[0] : ends[-1]], np.flatnonzero(n), np.zeros(len(n), np.int64)
                first = (ends[:-1] - ends[0])[full]
                for i in range(bits if len(full) else 0):
                    votes = np.add.reduceat(s >> i & 1, first)
                    code[full] |= (2 * votes > n[full]).astype(np.int64) << i
                out.append(code)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["doc_id", "simhash"])

    whole = sets.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    return whole.select(F.col("doc_id").cast("long").alias("doc_id"), "s").mapInArrow(run, "doc_id long, simhash long")


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def pair_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of a set of pairs (a, b); 0 where a denominator is empty."""
    both = predicted.select("a", "b", F.lit(1).alias("p")).join(truth.select("a", "b", F.lit(1).alias("t")), ["a", "b"], "full")
    n = both.agg(F.count_if(F.expr("p = 1 and t = 1")).alias("tp"), F.count_if(F.expr("p = 1 and t is null")).alias("fp"), F.count_if(F.expr("p is null and t = 1")).alias("fn"))
    return scored(n)


def scored(n: DataFrame) -> DataFrame:
    """(tp, fp, fn) with precision, recall and F1; 0 where a denominator is empty."""
    safe = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    n = n.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6).alias("f1"))


def collision_curve(spark, r: int, b: int, steps: int = 20) -> DataFrame:
    """1 - (1 - s^r)^b for s in 0..1, and the s at which it is a half."""
    s = F.col("id") / steps
    return spark.range(steps + 1).select(F.round(s, 6).alias("s"), F.round(1 - F.pow(1 - F.pow(s, r), F.lit(b)), 6).alias("p"), F.round(F.pow(1 - F.pow(F.lit(0.5), 1 / b), F.lit(1 / r)), 6).alias("halfway"))
