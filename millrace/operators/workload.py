"""Usage, prices and outcome summaries of request tables; mutations of texts for test corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.stats import running


def usage(requests: DataFrame, price_in: float = 3.0, price_out: float = 15.0) -> DataFrame:
    """requests (…, tokens_in, tokens_out) with cost in USD."""
    return requests.withColumn("usd", F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 9))


def outcomes(rows: DataFrame, by: str, ok: Column, latency: str, attempts: str) -> DataFrame:
    """Success share, attempts per success, wasted attempts, latency quantiles of successes, by group."""
    good = ok.cast("int")
    t = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(good).alias("won"), F.sum(attempts).alias("tries"),
        F.round(F.percentile(F.when(ok, F.col(latency)), 0.5), 6).alias("p50"), F.round(F.percentile(F.when(ok, F.col(latency)), 0.95), 6).alias("p95"),
    )
    share = F.round(F.col("won") / F.col("n"), 6)
    return t.select(by, "n", share.alias("success"), F.round(F.try_divide(F.col("tries"), F.col("won")), 6).alias("amplification"), F.round((F.col("tries") - F.col("won")) / F.col("tries"), 6).alias("wasted"), "p50", "p95")


def capped_exponential(attempt: Column, base_ms: float, cap_ms: float) -> Column:
    return F.least(F.lit(cap_ms), base_ms * F.pow(F.lit(2.0), attempt - 1))


def jittered(attempt: Column, key: Column, base_ms: float, cap_ms: float, kind: str = "full") -> Column:
    """Delay before a retry; the draw is a hash of key and attempt, so it can be made again."""
    u = F.pmod(F.xxhash64(key, attempt), F.lit(1 << 20)) / (1 << 20)
    d = capped_exponential(attempt, base_ms, cap_ms)
    return {"none": d, "full": u * d, "equal": d / 2 + u * d / 2}[kind]


def queue_length(rows: DataFrame, at: DataFrame, start: str = "queued", end: str = "left") -> DataFrame:
    """(t, n): rows with start <= t < end at each instant of `at` (t); both are sorted into one running sum."""
    steps = rows.select(F.col(start).alias("t"), F.lit(1).alias("d"), F.lit(0).alias("asks")).unionByName(rows.select(F.col(end).alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("asks")))
    every = steps.groupBy("t", "asks").agg(F.sum("d").alias("d")).unionByName(at.select("t", F.lit(1).alias("asks"), F.lit(0).cast("long").alias("d")).distinct())
    return running(every, ["t", "asks"], {"d": "n"}).where("asks = 1").select("t", "n")


def truncated(text: Column, share: float = 0.7) -> Column:
    """The first share of the words."""
    w = F.split(F.trim(text), r"\s+")
    return F.array_join(F.slice(w, 1, F.greatest(F.lit(1), F.floor(F.size(w) * share).cast("int"))), " ")


def dropped_words(text: Column, key: Column, share: float = 0.1) -> Column:
    """Words left when about a share of them, chosen by a hash of key and place, is dropped."""
    w = F.split(F.trim(text), r"\s+")
    kept = F.filter(w, lambda x, i: F.pmod(F.xxhash64(key, i), F.lit(1000)) >= int(share * 1000))
    return F.array_join(kept, " ")


def mutated(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, text): each document as it is and in three changed forms."""
    t = F.col("text")
    forms = {"same": t, "truncated": truncated(t), "dropped": dropped_words(t, F.col("doc_id")), "lower": F.lower(t)}
    forms = F.array(*[F.struct(F.lit(kind).alias("kind"), form.alias("text")) for kind, form in forms.items()])
    return docs.select("doc_id", F.explode(forms).alias("f")).select("doc_id", "f.kind", "f.text")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that can be reached over edges (src, dst) from start (node), by rounds over the new ones, each a checkpoint."""
    found = new = start.select("node").distinct().checkpoint()
    while not new.isEmpty():
        new = edges.join(new, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        new = new.checkpoint()
        found = found.unionByName(new)
    return found


def slot_rates(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Verdicts ('a', 'b' or 'tie') of both orders of a pair: how many agree, how many lean to the first or second place."""
    same = F.col(first) == F.col(second)
    return pairs.agg(
        F.count("*").alias("n"), F.count_if(same).alias("stable"),
        F.count_if((F.col(first) == "a") & (F.col(second) == "b")).alias("to_first"), F.count_if((F.col(first) == "b") & (F.col(second) == "a")).alias("to_second"),
        F.round(F.avg(F.when(F.col(first) == "a", 1.0).when(F.col(first) == "b", 0.0).otherwise(0.5)), 6).alias("first_rate"),
    )


def youngest_prefix(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each key the value of its last row, ties by value."""
    return rows.groupBy(key).agg(F.max(F.struct(at, value)).alias("m")).select(key, f"m.{at}", f"m.{value}")
