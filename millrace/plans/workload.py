"""Queries on usage, outcomes and changed texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import workload as W
from millrace.sources.tables import table


def order_outcomes(spark, d):
    o = table(spark, d, "orders").withColumn("tries", 1 + F.col("o_orderkey") % 3)
    return W.outcomes(o, "o_orderpriority", F.col("o_orderstatus") == "F", "o_totalprice", "tries")


def open_orders(spark, d):
    """How many line items lie between ship date and 30 days later, at the start of each month of ship dates."""
    li = table(spark, d, "lineitem").select(F.unix_date(F.col("l_shipdate").cast("date")).alias("queued"))
    at = li.select(F.unix_date(F.trunc(F.date_from_unix_date("queued"), "month")).alias("t")).distinct()
    return W.queue_length(li.withColumn("left", F.col("queued") + 30), at)


def mutations(spark, d):
    t = W.mutated(table(spark, d, "documents"))
    return t.where("kind in ('same', 'truncated', 'lower')").select("doc_id", "kind", F.md5(F.col("text").cast("binary")).alias("digest"))


def backoff(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 9 + 1).alias("attempt"))
    return e.select("event_id", W.capped_exponential(F.col("attempt"), 100.0, 5000.0).alias("delay"))


def verdict_flips(spark, d):
    side = lambda c: F.when(c % 3 == 0, "a").when(c % 3 == 1, "b").otherwise("tie")
    return W.slot_rates(table(spark, d, "lineitem").select(side(F.col("l_partkey")).alias("x"), side(F.col("l_suppkey")).alias("y")), "x", "y")


def last_event(spark, d):
    return W.youngest_prefix(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


QUERIES = {f.__name__: f for f in (order_outcomes, open_orders, mutations, backoff, verdict_flips, last_event)}
SIDE = "CASE WHEN {0} % 3 = 0 THEN 'a' WHEN {0} % 3 = 1 THEN 'b' ELSE 'tie' END"
ORACLES = {
    "order_outcomes": """WITH o AS (SELECT *, 1 + o_orderkey % 3 AS tries FROM orders) SELECT o_orderpriority, count(*) AS n, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS success,
      round(sum(tries) / count(*) FILTER (o_orderstatus = 'F'), 6) AS amplification, round((sum(tries) - count(*) FILTER (o_orderstatus = 'F')) / sum(tries), 6) AS wasted,
      round(quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'F'), 6) AS p50, round(quantile_cont(o_totalprice, 0.95) FILTER (o_orderstatus = 'F'), 6) AS p95 FROM o GROUP BY 1""",
    "open_orders": """WITH l AS (SELECT CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS q FROM lineitem), c AS (SELECT q, count(*) AS n FROM l GROUP BY q), t AS (SELECT DISTINCT CAST(date_trunc('month', DATE '1970-01-01' + CAST(q AS INT)) AS DATE) - DATE '1970-01-01' AS t FROM l)
      SELECT CAST(t AS INT) AS t, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM t LEFT JOIN c ON q <= t AND t < q + 30 GROUP BY t""",
    "mutations": r"""WITH w AS (SELECT doc_id, text, regexp_split_to_array(trim(text), '\s+') AS w FROM documents)
      SELECT doc_id, 'same' AS kind, md5(text) AS digest FROM w UNION ALL SELECT doc_id, 'lower', md5(lower(text)) FROM w UNION ALL SELECT doc_id, 'truncated', md5(array_to_string(w[1:greatest(1, CAST(floor(len(w) * 0.7::DOUBLE) AS INT))], ' ')) FROM w""",
    "backoff": "SELECT event_id, least(5000.0::DOUBLE, 100.0::DOUBLE * pow(2.0, event_id % 9)) AS delay FROM events",
    "verdict_flips": f"""WITH v AS (SELECT {SIDE.format('l_partkey')} AS x, {SIDE.format('l_suppkey')} AS y FROM lineitem) SELECT count(*) AS n, count(*) FILTER (x = y) AS stable, count(*) FILTER (x = 'a' AND y = 'b') AS to_first,
      count(*) FILTER (x = 'b' AND y = 'a') AS to_second, round(avg(CASE x WHEN 'a' THEN 1.0::DOUBLE WHEN 'b' THEN 0 ELSE 0.5 END), 6) AS first_rate FROM v""",
    "last_event": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
}
