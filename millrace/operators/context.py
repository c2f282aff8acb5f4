"""Conversations and traffic: token accounts, window policies, prices, salience; windows over time stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

IN, OUT = 3.0, 15.0  #: USD for a million tokens


def accounts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, tokens, so_far): estimated tokens of each turn and of all up to it."""
    t = turns.select("conv_id", "turn", "role", T.tokens_estimate(F.col("text")).alias("tokens"))
    return t.withColumn("so_far", F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))


def prices(turns: DataFrame) -> DataFrame:
    """(conv_id, tokens_in, tokens_out, usd): each assistant turn reads all before it and writes itself."""
    a = accounts(turns).where("role = 'assistant'")
    s = a.groupBy("conv_id").agg(F.sum(F.col("so_far") - F.col("tokens")).alias("tokens_in"), F.sum("tokens").alias("tokens_out"))
    return s.select("*", F.round((F.col("tokens_in") * IN + F.col("tokens_out") * OUT) / 1e6, 9).alias("usd"))


def incremental(turns: DataFrame, read: float = 0.1, write: float = 1.25) -> DataFrame:
    """(conv_id, usd) of an append-only trace with a prefix cache: what was there is read, what is new is written."""
    a = accounts(turns).where("role = 'assistant'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    prefix = F.col("so_far") - F.col("tokens")
    before = F.coalesce(F.lag(prefix).over(w), F.lit(0))
    rows = a.select("conv_id", (before * read + (prefix - before) * write).alias("billed"), "tokens")
    return rows.groupBy("conv_id").agg(F.round((F.sum("billed") * IN + F.sum("tokens") * OUT) / 1e6, 9).alias("usd"))


def sliding(turns: DataFrame, budget: int = 300) -> DataFrame:
    """(conv_id, turn): the newest turns whose tokens fit; the first that doesn't ends the choice."""
    t = turns.select("conv_id", "turn", T.tokens_estimate(F.col("text")).alias("tokens"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("cost", F.sum("tokens").over(back)).where(F.col("cost") <= budget).select("conv_id", "turn", "cost")


def head_and_tail(turns: DataFrame, budget: int = 300, head: int = 1) -> DataFrame:
    """(conv_id, turn): the first turns always, the newest of the others while they fit."""
    t = turns.select("conv_id", "turn", T.tokens_estimate(F.col("text")).alias("tokens"))
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    t = t.withColumn("fixed", F.sum(F.when(F.col("place") <= head, F.col("tokens")).otherwise(0)).over(Window.partitionBy("conv_id")))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    cost = F.sum(F.when(F.col("place") > head, F.col("tokens")).otherwise(0)).over(back) + F.col("fixed")
    return t.withColumn("cost", cost).where((F.col("place") <= head) | (F.col("cost") <= budget)).select("conv_id", "turn")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, blocks, digest): length and digest of the request that ends with a turn, over digests of its blocks."""
    line = F.sha2(F.concat_ws(": ", "role", F.coalesce("text", F.lit(""))).cast("binary"), 256)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", "turn", line.alias("d")).withColumn("all", F.collect_list("d").over(w))
    return rows.select("conv_id", "turn", F.size("all").alias("blocks"), F.sha2(F.array_join("all", "").cast("binary"), 256).alias("digest"))


def rarity(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, score): mean ln(N / tf) over a turn's distinct content words, N and tf within the conversation."""
    w = turns.select("conv_id", "turn", F.explode(T.content_words(F.col("text"))).alias("w"))
    tf = w.groupBy("conv_id", "w").agg(F.countDistinct("turn").alias("sf"))
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    rows = w.distinct().join(tf, ["conv_id", "w"]).join(n, "conv_id")
    return rows.groupBy("conv_id", "turn").agg(F.round(F.avg(F.log(F.col("n") / F.col("sf"))), 6).alias("score"))


def millis(ts: str = "ts"):
    return F.unix_millis(F.col(ts).cast("timestamp"))


def peak_windows(events: DataFrame, by: str, width_ms: int) -> DataFrame:
    """(by, peak): the most events in any half-open window of a width that begins at an event."""
    e = events.select(by, millis().alias("ms"))
    w = Window.partitionBy(by).orderBy("ms").rangeBetween(0, width_ms - 1)
    return e.withColumn("n", F.count("*").over(w)).groupBy(by).agg(F.max("n").alias("peak"))


def timeline(events: DataFrame, width_ms: int) -> DataFrame:
    """(bin, n, mean): events and their mean value by time bin from the first event; empty bins stay."""
    e = events.select(millis().alias("ms"), "value")
    lo = e.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    bins = lo.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / width_ms).cast("long"))).alias("bin"))
    got = e.join(F.broadcast(lo.select("lo"))).groupBy(F.floor((F.col("ms") - F.col("lo")) / width_ms).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return bins.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def rolling_rate(events: DataFrame, by: str, bad, width_ms: int) -> DataFrame:
    """(event_id, volume, rate): share of bad events of a key in the window (t - width, t]."""
    w = Window.partitionBy(by).orderBy("ms").rangeBetween(-(width_ms - 1), 0)
    e = events.select("event_id", by, millis().alias("ms"), bad.cast("int").alias("bad"))
    return e.select("event_id", F.count("*").over(w).alias("volume"), F.round(F.sum("bad").over(w) / F.count("*").over(w), 6).alias("rate"))


def sessions(events: DataFrame, by: str, gap_ms: int) -> DataFrame:
    """(by, session, n, first, last): runs of events whose gaps are at most gap_ms."""
    w = Window.partitionBy(by).orderBy("ms", "event_id")
    e = events.select(by, "event_id", millis().alias("ms"))
    e = e.withColumn("new", F.coalesce((F.col("ms") - F.lag("ms").over(w) > gap_ms).cast("int"), F.lit(0)))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(by, "session").agg(F.count("*").alias("n"), F.min("ms").alias("first"), F.max("ms").alias("last"))
