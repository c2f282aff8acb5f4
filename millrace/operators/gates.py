"""Regression gates over paired outcomes of two runs, by a paired bootstrap that can be made again anywhere.

outcomes: (item, slice, old, new), old and new being 0 or 1. Items are numbered within their slice, and over all, by
item; a resample draws numbers by a hash of round, slice and place, so no task needs another's random state. The
number of rounds is a parameter of the test; what is shuffled is a byte for each slice and item, once for each
ROUNDS_TOGETHER rounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.digests import digest_heads
from millrace.operators.stats import benjamini_hochberg, kept, rounded

ALL = "*"  #: the slice of all items
ROUNDS, MOST, ALPHA = 200, 0.02, 0.025
NONE = -128  #: instead of a difference that is null
ROUNDS_TOGETHER = 4  #: rounds for which a slice's differences go to a task
PACKED = 1 << 27  #: items of the largest slice whose differences go to tasks as a byte each
STEP = 1 << 20  #: draws that are looked up together


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(item, slice, old, new) of two runs (item, slice, ok) over the same items; other items are an error."""
    both = old.select("item", "slice", F.col("ok").cast("int").alias("old")).join(new.select("item", F.col("ok").cast("int").alias("new")), "item", "full")
    odd = both.where("old is null or new is null").limit(1).count()
    if odd:
        raise ValueError("the runs are over different items")
    return both


def with_all(outcomes: DataFrame) -> DataFrame:
    """(slice, item, v): differences within each slice and over all; outcomes without a slice count over all only."""
    v = (F.col("new").cast("int") - F.col("old").cast("int")).alias("v")
    return outcomes.select("slice", "item", v).where("slice is not null").unionByName(outcomes.select(F.lit(ALL).alias("slice"), "item", v))


def blocks(rows: DataFrame) -> DataFrame:
    """(slice, part, v): the differences of each slice in order of item, a byte each, NONE for null: the blocks of the range
    partitions, in order of part. No task sorts more than its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held = TaskContext.get().partitionId(), None, []

        def block() -> pa.RecordBatch:
            v = np.concatenate(held).astype(np.int8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part], pa.int32()), pa.array([v], pa.binary())], names=["slice", "part", "v"])

        for b in batches:
            names = b.column(0).dictionary_encode()
            code, v = names.indices.to_numpy(), b.column(1).fill_null(NONE).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for i, j in zip(cut, cut[1:]):
                if i == j:
                    continue
                name = names.dictionary[int(code[i])].as_py()
                if held and name != at:
                    yield block()
                    held = []
                at = name
                held.append(v[i:j])
        if held:
            yield block()

    dealt = rows.repartitionByRange("slice", "item").sortWithinPartitions("slice", "item")
    return dealt.select(F.col("slice").cast("string").alias("slice"), "v").mapInArrow(run, "slice string, part int, v binary")


def drawn_sums(v: np.ndarray, name: str, rounds: Iterable[int]) -> list[tuple[int, int, int]]:
    """(round, sum, how many aren't null) of len(v) draws from v with replacement: in each round, draw i takes the number that
    the first eight hexadecimal digits of MD5 of round-slice-i say, modulo len(v)."""
    value, known, some = np.where(v == NONE, 0, v).astype(np.int64), v != NONE, bool((v == NONE).any())
    out = []
    for r in rounds:
        total = count = 0
        for first in range(0, len(v), STEP):
            k = digest_heads(f"{r}-{name}-".encode(), first, min(len(v), first + STEP)) % len(v)
            total += int(value[k].sum())
            count += int(known[k].sum()) if some else len(k)
        out.append((r, total, count))
    return out


def resampled_means(packed: DataFrame, rounds: int) -> DataFrame:
    """(slice, round, m): the means of all rounds. A task has the packed differences of a slice and some rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for (name, first), group in groupby(rows, lambda r: (r["slice"], r["first"])):
            v = np.concatenate([np.frombuffer(r["v"], np.int8) for r in group])
            found = drawn_sums(v, name, range(first, min(rounds, first + ROUNDS_TOGETHER)))
            r, total, count = map(list, zip(*found))
            columns = [pa.array([name] * len(r)), pa.array(r, pa.int32()), pa.array([t if c else None for t, c in zip(total, count)], pa.int64()), pa.array([len(v)] * len(r), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "round", "total", "n"])

    tasks = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), packed.sparkSession.sparkContext.defaultParallelism)
    each = packed.select("slice", "part", "v", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(ROUNDS_TOGETHER))).alias("first"))
    each = each.repartition(tasks, "slice", "first").sortWithinPartitions("slice", "first", "part")
    sums = each.mapInArrow(run, "slice string, round int, total long, n long")
    return sums.select("slice", "round", F.round(F.col("total") / F.col("n"), 9).alias("m"))


def resampled_means_by_rows(rows: DataFrame, rounds: int) -> DataFrame:
    """The same, of slices of any size: a row for each round, slice and item is shuffled."""
    w = Window.partitionBy("slice").orderBy("item")
    rows = rows.select("slice", "v", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("slice")).alias("n"))
    drawn = rows.select("slice", "n", "i", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    h = F.conv(F.substring(F.md5(F.concat_ws("-", "round", "slice", "i").cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = drawn.select("slice", "round", (h % F.col("n")).alias("i")).groupBy("slice", "round", "i").count()
    means = drawn.join(rows.select("slice", "i", "v", "n"), ["slice", "i"]).groupBy("slice", "round")
    return means.agg(F.round(F.sum(F.col("v") * F.col("count")) / F.first("n"), 9).alias("m"))


def resampled(outcomes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(slice, n, delta, low, high, p): mean difference, its 95% percentile interval, and the share of resampled means
    of at least 0, which is the p of a regression. Slices of up to PACKED items are resampled as packed differences,
    larger ones as rows."""
    rows = kept(with_all(outcomes))
    by = kept(rows.groupBy("slice").agg(F.count("*").alias("n"), rounded(F.avg("v"), "delta")))
    large, whole = by.where(F.col("n") > PACKED).select("slice"), rows
    if large.limit(1).count():
        whole = rows.join(large, "slice", "left_anti")
    means = resampled_means(blocks(whole), rounds)
    if whole is not rows:
        means = means.unionByName(resampled_means_by_rows(rows.join(large, "slice", "left_semi"), rounds))
    ci = means.groupBy("slice").agg(rounded(F.percentile("m", 0.025), "low"), rounded(F.percentile("m", 0.975), "high"), rounded(F.avg((F.col("m") >= 0).cast("double")), "p"))
    return kept(by.join(ci, "slice").select("slice", "n", "delta", "low", "high", "p"))


def verdicts(table: DataFrame, most: float = MOST, alpha: float = ALPHA) -> DataFrame:
    """One row: whether each gate fails, from a result of resampled().

    naive: the drop is over `most`; ci: the interval lies below 0; slice: that of any slice does; combined: ci or slice;
    bonferroni: any slice's p is at most alpha / slices; bh: step-up rejects any slice; combined_bh: ci or bh."""
    slices = table.where(F.col("slice") != ALL)
    bh = benjamini_hochberg(slices, "slice", "p", alpha).agg(F.coalesce(F.max("rejected"), F.lit(False)).alias("bh"))
    whole = table.where(F.col("slice") == ALL).agg(F.coalesce(F.max(F.col("delta") < -most), F.lit(False)).alias("naive"), F.coalesce(F.max(F.col("high") < 0), F.lit(False)).alias("ci"))
    by = slices.agg(F.coalesce(F.max(F.col("high") < 0), F.lit(False)).alias("slice"), F.coalesce(F.min("p") <= alpha / F.count("*"), F.lit(False)).alias("bonferroni"))
    return whole.join(by).join(bh).select("naive", "ci", "slice", (F.col("ci") | F.col("slice")).alias("combined"), "bonferroni", "bh", (F.col("ci") | F.col("bh")).alias("combined_bh"))


def changes(outcomes: DataFrame) -> DataFrame:
    """(slice, n, old, new, improved, regressed) by slice and over all."""
    t = outcomes.rollup("slice").agg(
        F.grouping("slice").alias("g"), F.count("*").alias("n"), rounded(F.avg("old"), "old_rate"), rounded(F.avg("new"), "new_rate"),
        F.count_if(F.expr("new > old")).alias("improved"), F.count_if(F.expr("new < old")).alias("regressed"),
    )
    return t.select(F.when(F.col("g") == 1, ALL).otherwise(F.col("slice")).alias("slice"), "n", F.col("old_rate").alias("old"), F.col("new_rate").alias("new"), "improved", "regressed")


def failure_rates(reruns: DataFrame, most: float = MOST, rounds: int = ROUNDS) -> DataFrame:
    """(gate, failures, runs, rate) over reruns (run, item, slice, old, new): each run is gated by itself."""
    keyed = reruns.select("item", F.concat_ws("/", "run", "slice").alias("slice"), "old", "new")
    whole = reruns.select("item", F.concat_ws("/", "run", F.lit(ALL)).alias("slice"), "old", "new")
    t = resampled(keyed.unionByName(whole), rounds).where(F.col("slice") != ALL)
    t = t.select(F.split("slice", "/")[0].alias("run"), F.split("slice", "/")[1].alias("slice"), "delta", "high", "p")
    is_all = F.col("slice") == ALL
    by = t.groupBy("run").agg(
        F.max(F.when(is_all, F.col("delta") < -most)).alias("naive"), F.max(F.when(is_all, F.col("high") < 0)).alias("ci"),
        F.coalesce(F.max(F.when(~is_all, F.col("high") < 0)), F.lit(False)).alias("slice"),
    )
    gates = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).cast("int").alias("f")) for g in ("naive", "ci", "slice")])
    rows = by.select(F.explode(gates).alias("g")).select("g.gate", "g.f")
    return rows.groupBy("gate").agg(F.sum("f").alias("failures"), F.count("*").alias("runs"), rounded(F.avg("f"), "rate"))


def stable_u64(*parts) -> F.col:
    """The first eight bytes of SHA-256 of the parts joined by U+001F, as a decimal number."""
    digest = F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
