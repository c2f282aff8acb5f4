"""Queries on stateful folds over events; sequences that SQL can't express, so they have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.context import millis
from millrace.sources.tables import table
from millrace.streaming import state


def rows(spark, d):
    e = table(spark, d, "events").withColumn("ms", millis())
    return e.select("user_id", "event_id", "ms", (F.col("value") >= 10).alias("ok"), (F.col("event_id") % 3 == 0).alias("retry"))


def token_bucket(spark, d):
    return state.batch(rows(spark, d), "user_id", lambda: state.TokenBucket(1 / 86400, 2), "admitted boolean, level double")


def breaker_trips(spark, d):
    return state.batch(rows(spark, d), "user_id", lambda: state.Breaker(2, 86_400_000), "passed boolean, state string")


def rolling_breaker(spark, d):
    return state.batch(rows(spark, d), "user_id", lambda: state.RollingBreaker(864_000_000, 3, 0.5, 86_400_000), "passed boolean, state string")


def retry_budget(spark, d):
    return state.batch(rows(spark, d), "user_id", lambda: state.RetryBudget(0.2, 2), "allowed boolean, left double")


def prefix_cache(spark, d):
    """Each conversation's requests a minute apart: blocks are turns."""
    from pyspark.sql import Window

    from millrace.functions import text as T

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws(": ", "role", "text").cast("binary"), 256).alias("d"), T.tokens_estimate(F.col("text")).alias("n"))
    t = t.select("conv_id", F.col("turn").alias("event_id"), (F.col("turn") * 60_000).alias("ms"), F.collect_list("d").over(w).alias("digests"), F.collect_list("n").over(w).alias("sizes"))
    return state.batch(t, "conv_id", lambda: state.PrefixCache(ttl=300_000, least=256), "cached long, written long, billed double")


QUERIES = {f.__name__: f for f in (token_bucket, breaker_trips, rolling_breaker, retry_budget, prefix_cache)}
ORACLES: dict[str, str] = {}


def fixed_chunks(spark, d):
    from millrace.operators import records

    c = records.fixed_chunks(table(spark, d, "documents"), 80, 20)
    return c.select("doc_id", "chunk_id", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n_words"))


def sentence_chunks(spark, d):
    from millrace.operators import records

    return records.sentence_chunks(table(spark, d, "documents"), 80).drop("text")


def event_props(spark, d):
    """Leaves of the events' JSON."""
    from millrace.operators import records

    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("text"))
    return records.flattened(records.repaired(e).where("json is not null"))


QUERIES |= {f.__name__: f for f in (fixed_chunks, sentence_chunks, event_props)}
ORACLES |= {
    "fixed_chunks": r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents), c AS (SELECT doc_id, n, unnest(generate_series(0, greatest(0, CAST(ceil((n - 80) / 60) AS BIGINT)))) AS k FROM w WHERE n > 0)
      SELECT doc_id, doc_id || '#' || k AS chunk_id, CAST(least(80, n - 60 * k) AS INT) AS n_words FROM c""",
    "event_props": "SELECT event_id AS id, unnest(json_keys(props)) AS path, CAST(json_extract(props, '$.' || unnest(json_keys(props))) AS VARCHAR) AS value FROM events",
}


def knn_graph(spark, d):
    """Approximate neighbours; recall against exact search is tested."""
    from millrace.operators import ann
    from millrace.plans.analysis import vectors

    return ann.knn(*vectors(spark, d))


QUERIES |= {"knn_graph": knn_graph}
