"""Scores of extracted records against gold ones: a ladder of equalities, array alignment, tallies by path, damage.

Records are leaf tables (id, path, value) as `records.flattened` gives them; values are JSON. Counts are partial
aggregates; only the alignment of one record's array is a fold, over the pairs of that array's elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.stats import rounded, safe

LADDER = ("exact", "numeric", "date", "text")
ROUNDS, PAIRS = 8, 1 << 17  #: of taking pairs together, and how many pairs are held for it
KINDS = ("correct", "wrong", "missing", "spurious")


def bare(value: Column) -> Column:
    """A JSON string without its quotes; other values as they are written."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)


def is_number(value: Column) -> Column:
    return value.rlike(r"^-?[0-9]")


def values_match(gold: Column, said: Column, upto: str = "text", tolerance: float = 0.0) -> Column:
    """Whether two JSON values are equal on the ladder up to a rung. A rung counts only where both sides can be read by
    it; a JSON number and something that isn't a number never match."""
    rungs = LADDER[1 : LADDER.index(upto) + 1]
    g, s = bare(gold), bare(said)
    out = F.when(gold == said, True)
    if "numeric" in rungs:
        gn, sn = T.number_of(g), T.number_of(s)
        out = out.when(gn.isNotNull() & sn.isNotNull(), F.abs(gn - sn) <= tolerance)
        out = out.when((gn.isNotNull() | sn.isNotNull()) & (is_number(gold) | is_number(said)), False)
    strings = gold.startswith('"') & said.startswith('"')
    if "date" in rungs:
        gd, sd = T.date_of(g), T.date_of(s)
        out = out.when(strings & gd.isNotNull() & sd.isNotNull(), gd == sd)
    if "text" in rungs:
        out = out.when(strings, T.folded_space(g) == T.folded_space(s))
    return F.coalesce(out.otherwise(False), F.lit(False))


def match_keys(value: Column, upto: str = "text") -> Column:
    """One or two keys of a JSON value: values that match without tolerance share one. Numbers and dates that are read have
    their value; the text of a string is a second key, for it decides where the other side reads otherwise."""
    rungs = LADDER[1 : LADDER.index(upto) + 1]
    v, string, as_is = bare(value), value.startswith('"'), F.concat(F.lit("e"), value)
    read = [F.concat(F.lit("n"), (T.number_of(v) + 0.0).cast("string"))] if "numeric" in rungs else []  # 0.0 for -0.0 as well
    if "date" in rungs:
        read.append(F.when(string, F.concat(F.lit("d"), T.date_of(v))))
    if "text" not in rungs:
        return F.array(F.coalesce(*read, as_is))
    text = F.concat(F.lit("t"), T.folded_space(v))
    return F.when(string, F.array_compact(F.array(F.coalesce(*read), text))).otherwise(F.array(F.coalesce(read[0], as_is)))


def tallied(gold: DataFrame, said: DataFrame, upto: str = "text", tolerance: float = 0.0) -> DataFrame:
    """(path, correct, wrong, missing, spurious) by generic path; a leaf that only one side has charges that side, so a
    subtree in place of a leaf charges every leaf of it."""
    both = gold.select("id", "path", F.col("value").alias("g")).join(said.select("id", "path", F.col("value").alias("s")), ["id", "path"], "full")
    kind = F.when(F.col("s").isNull(), "missing").when(F.col("g").isNull(), "spurious").when(values_match(F.col("g"), F.col("s"), upto, tolerance), "correct").otherwise("wrong")
    rows = both.select(F.regexp_replace("path", r"\[[0-9]+\]", "[]").alias("path"), kind.alias("kind"))
    return rows.groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def merged(*tallies: DataFrame) -> DataFrame:
    """Tallies of several comparisons as one."""
    out = tallies[0]
    for t in tallies[1:]:
        out = out.unionByName(t)
    return out.groupBy("path").agg(*[F.sum(k).alias(k) for k in KINDS])


def by_path(tallies: DataFrame) -> DataFrame:
    """Tallies with precision, recall and F1 of each path."""
    c, w, m, s = (F.col(k) for k in KINDS)
    p, r = safe(c, c + w + s), safe(c, c + w + m)
    return tallies.select("*", rounded(p, "precision"), rounded(r, "recall"), rounded(safe(2 * p * r, p + r), "f1"))


def macro(tallies: DataFrame) -> DataFrame:
    """(macro_f1, paths): mean F1 over the paths that have gold leaves."""
    rows = by_path(tallies).where("correct + wrong + missing > 0")
    return rows.agg(rounded(F.coalesce(F.avg("f1"), F.lit(0.0)), "macro_f1", 5), F.count("*").alias("paths"))


def exact_rate(gold: DataFrame, said: DataFrame) -> DataFrame:
    """(n, exact, rate): records whose leaves are all the same, in canonical form."""
    whole = lambda t, name: t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias(name))
    both = whole(gold, "g").join(whole(said, "s"), "id", "left")
    t = both.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("g") == F.col("s"), F.lit(False))).alias("exact"))
    return t.select("n", "exact", rounded(safe(F.col("exact"), F.col("n")), "rate"))


def leaf_counts(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("id").agg(F.count("*").alias("leaves"))


def element_scores(gold: DataFrame, said: DataFrame, upto: str = "text") -> DataFrame:
    """(id, gi, pi, f1): F1 of each pair of elements that share a leaf. gold, said: (id, element, path, value). Leaves meet by
    keys of their values, so what an array's leaves of one path cost doesn't grow with the square of their number."""
    size = lambda t, name: t.groupBy("id", "element").agg(F.count("*").alias(name))
    def keyed(t: DataFrame, element: str, read: str) -> DataFrame:
        t = t.select("id", F.col("element").alias(element), "path", match_keys(F.col("value"), upto).alias("k"))
        t = t.select("id", element, "path", F.posexplode("k").alias("place", "key"), F.col("k")[0].alias("first"))
        return t.select("id", element, "path", "key", F.when(F.col("place") > 0, F.left("first", F.lit(1))).alias(read))

    # a text counts where not both sides are read as numbers, or both as dates: then those decide, by their own key
    same = keyed(gold, "gi", "g").join(keyed(said, "pi", "s"), ["id", "path", "key"]).where("g is null or s is null or g != s")
    same = same.groupBy("id", "gi", "pi").agg(F.count("*").alias("c"))
    same = same.join(size(gold, "n").withColumnRenamed("element", "gi"), ["id", "gi"]).join(size(said, "m").withColumnRenamed("element", "pi"), ["id", "pi"])
    return same.select("id", "gi", "pi", F.round(2 * F.col("c") / (F.col("n") + F.col("m")), 9).alias("f1"))


def greedy(new: np.ndarray, gi: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Places of the pairs that are taken; pairs come by record, in the order in which they are tried. new: whether a pair is
    its record's first. A pair that comes first of those of its left and of its right element is taken, and what has an
    element in common with it goes; so all records are worked on together."""
    record = np.cumsum(new)
    taken, rest = [], np.arange(len(new))
    left, right = (coded(record, x) for x in (gi, pi))
    gone = [np.zeros(int(x.max(initial=-1)) + 1, bool) for x in (left, right)]
    for _ in range(ROUNDS):
        if not len(rest):
            break
        x, y, n = left[rest], right[rest], np.arange(len(rest))
        one, other = (np.full(len(g), len(rest)) for g in gone)
        one[x[::-1]], other[y[::-1]] = n[::-1], n[::-1]  # of an element's pairs the first one is written last
        best = (one[x] == n) & (other[y] == n)
        taken.append(rest[best])
        gone[0][x[best]] = gone[1][y[best]] = True
        rest = rest[~(gone[0][x] | gone[1][y])]
    lefts, rights = set(), set()
    for k, x, y in zip(rest.tolist(), left[rest].tolist(), right[rest].tolist()):  # long chains, pair by pair
        if x not in lefts and y not in rights:
            lefts.add(x)
            rights.add(y)
            taken.append(np.array([k]))
    return np.sort(np.concatenate(taken)) if taken else rest


def coded(record: np.ndarray, element: np.ndarray) -> np.ndarray:
    """Numbers from 0 on of distinct (record, element)."""
    by = np.lexsort((element, record))
    r, e = record[by], element[by]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(np.r_[False, (r[1:] != r[:-1]) | (e[1:] != e[:-1])][: len(by)])
    return out


def aligned(scores: DataFrame) -> DataFrame:
    """(id, gi, pi, f1): pairs taken by falling F1, then by gold and said place, each element once. Records lie side by side
    in their tasks and are worked on many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = None, 0
        parts: list[pa.RecordBatch] = []

        def chosen(t: pa.Table) -> Iterator[pa.RecordBatch]:
            codes = t.column("id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            new = np.r_[True, codes[1:] != codes[:-1]]
            take = greedy(new, t.column("gi").to_numpy(), t.column("pi").to_numpy())
            yield from t.take(pa.array(take)).combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            if parts and held >= PAIRS:  # what is held ends where its last record does
                same = pc.fill_null(pc.equal(ids, open_), False) if open_.is_valid else pc.is_null(ids)
                stop = pc.index(same, False).as_py()
                if stop != -1:
                    parts.append(b.slice(0, stop))
                    yield from chosen(pa.Table.from_batches(parts))
                    parts, held, b = [], 0, b.slice(stop)
            parts.append(b)
            held += b.num_rows
            open_ = b.column(0)[b.num_rows - 1]
        if parts:
            yield from chosen(pa.Table.from_batches(parts))

    rows = scores.select("id", "gi", "pi", "f1").repartition("id").sortWithinPartitions("id", F.desc("f1"), "gi", "pi")
    return rows.mapInArrow(run, rows.schema)


def realigned(said: DataFrame, pairs: DataFrame) -> DataFrame:
    """said (id, element, path, value) with elements numbered as the gold ones that they are aligned with; others keep
    numbers of their own, so that a comparison charges them."""
    rows = said.join(pairs.select("id", F.col("pi").alias("element"), "gi"), ["id", "element"], "left")
    return rows.select("id", F.coalesce("gi", -1 - F.col("element")).alias("element"), "path", "value")


def dropped_leaves(leaves: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Leaves without about a share of them, chosen by a hash."""
    return leaves.where(draw(seed) >= share)


def corrupted_leaves(leaves: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Leaves of which about a share has another value: numbers are one more, others get a mark."""
    other = F.when(is_number(F.col("value")), (F.col("value").cast("double") + 1).cast("string")).otherwise(F.to_json(F.struct(F.concat(bare(F.col("value")), F.lit("~")).alias("v"))))
    other = F.when(is_number(F.col("value")), other).otherwise(F.regexp_extract(other, r'^\{"v":(.*)\}$', 1))
    return leaves.withColumn("value", F.when(draw(seed) < share, other).otherwise(F.col("value")))


def draw(seed: int) -> Column:
    text = F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"), "path")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Elements (id, element, …) of each array in an order given by a hash."""
    from pyspark.sql import Window

    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"), F.col("element").cast("string")).cast("binary"))
    place = F.dense_rank().over(Window.partitionBy("id").orderBy(key, "element")) - 1
    return rows.withColumn("element", place)


def extracted(rows: DataFrame, required: tuple[str, ...], retries: int = 2) -> DataFrame:
    """(id, attempt, json) of each ticket's first attempt (id, attempt, text), of `retries` + 1 at most, that reads as an
    object with all required fields; null where none does: never part of a record."""
    from millrace.functions import parsing as P

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [P.lenient(t)[1] for t in b["text"]]
            fits = [None if v is None or any(v.get(k) in (None, "") for k in required) else P.canonical(v) for v in found]
            yield pd.DataFrame({"id": b["id"], "attempt": b["attempt"], "json": fits})

    tried = rows.where(F.col("attempt") <= retries).select("id", "attempt", "text").mapInPandas(run, "id long, attempt int, json string")
    return tried.groupBy("id").agg(F.min(F.when(F.col("json").isNotNull(), F.col("attempt"))).alias("attempt"), F.min_by("json", F.when(F.col("json").isNotNull(), F.col("attempt"))).alias("json"))
