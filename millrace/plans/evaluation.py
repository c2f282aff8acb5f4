"""Queries on measures of classifiers, selections and rankings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators import retrieval as R
from millrace.operators import stats as M
from millrace.plans import retrieval as P
from millrace.plans.analysis import SCORED, SWEEP, scored
from millrace.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LOGITS = "x AS (SELECT vec_id, [v::DOUBLE for v in embedding] AS z, CAST(label % len(embedding) AS INT) AS y FROM embeddings)"


def lse(t: str) -> str:
    return f"list_max(z) / {t} + ln(list_sum([exp((v - list_max(z)) / {t}) for v in z]))"


def likelihood_sql(t: float) -> str:
    return f"""WITH {LOGITS}, l AS (SELECT z, y, {lse(f'{t}::DOUBLE')} AS lse FROM x)
      SELECT round(avg(lse - z[y + 1] / {t}::DOUBLE), 5) AS nll, round(avg((list_position(z, list_max(z)) - 1 = y)::INT), 6) AS accuracy,
        round(avg(list_sum([exp(v / {t}::DOUBLE - lse) ** 2 for v in z]) - 2 * exp(z[y + 1] / {t}::DOUBLE - lse) + 1), 5) AS brier FROM l"""


def logits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") % F.size("embedding")).cast("int").alias("y"))


@query(likelihood_sql(1.0))
def likelihood(spark, d):
    return E.likelihood(logits(spark, d), "embedding", "y")


@query(likelihood_sql(2.0))
def likelihood_at_temperature(spark, d):
    return E.likelihood(logits(spark, d), "embedding", "y", 2.0)


@query(f"WITH {LOGITS} SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INT) AS predicted, round(list_reverse_sort(z)[1] - list_reverse_sort(z)[2], 6) AS margin, round(z[1] - ({lse('1')}), 6) AS first_log_p FROM x")
def predictions(spark, d):
    z = F.transform("embedding", lambda x: x.cast("double"))
    return logits(spark, d).select("vec_id", E.argmax(z).alias("predicted"), F.round(E.logit_margin(F.col("embedding")), 6).alias("margin"), F.round(E.log_softmax(F.col("embedding"))[0], 6).alias("first_log_p"))


@query(f"""WITH {SCORED}, t AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 2.0]::DOUBLE[]) AS threshold)
  SELECT threshold, count(l.score) AS n, round(count(l.score) / (SELECT count(*) FROM l), 6) AS coverage, round(coalesce(avg(good::INT), 1), 6) AS accuracy FROM t LEFT JOIN l ON l.score >= threshold GROUP BY threshold""")
def selective_rows(spark, d):
    return E.selective(scored(spark, d), "good", "score", [0.0, 0.25, 0.5, 0.75, 2.0])


@query(f"""WITH {SCORED}, n AS (SELECT count(*) AS n, sum(good::INT) AS k FROM l), i AS (SELECT n, k, unnest(generate_series(1, n)) AS i FROM n)
  SELECT round(avg(greatest(0, i - k) / i), 5) AS oracle_aurc, round(any_value(1 - k / n), 5) AS random_aurc FROM i""")
def aurc_bounds(spark, d):
    return E.aurc_bounds(scored(spark, d), "good")


@query(f"""WITH {SCORED}, rc AS (SELECT row_number() OVER w AS place, round(sum((NOT good)::INT) OVER (w ROWS UNBOUNDED PRECEDING) / row_number() OVER w, 6) AS risk FROM l WINDOW w AS (ORDER BY score DESC, doc_id)),
  c AS (SELECT c, ceil(round(c * (SELECT count(*) FROM l), 9)) AS place FROM (SELECT unnest([0.1, 0.25, 0.5, 0.9, 1.0]::DOUBLE[]) AS c)) SELECT c AS coverage, risk FROM c JOIN rc USING (place)""")
def risk_at_coverage(spark, d):
    return E.risk_at(M.risk_coverage(scored(spark, d), "doc_id", "good", "score"), [0.1, 0.25, 0.5, 0.9, 1.0])


CLASSES = ["de", "en", "es", "fr", "xx"]


@query(f"""WITH {SCORED} SELECT c AS class, count(score) AS n, round(coalesce(avg(score), 0), 6) AS mean, round(coalesce(min(score), 0), 6) AS least, round(coalesce(max(score), 0), 6) AS most
  FROM (SELECT unnest({CLASSES}) AS c) LEFT JOIN l ON lang = c GROUP BY c""")
def class_stats(spark, d):
    return E.class_stats(scored(spark, d), "lang", "score", CLASSES)


@query(f"WITH {SCORED} SELECT lang AS class, t AS threshold, round(avg((score >= t)::INT), 6) AS share FROM l, (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS t) GROUP BY ALL")
def operating_table(spark, d):
    return E.operating_table(scored(spark, d), "lang", "score", [0.2, 0.5, 0.8])


@query(f"WITH {SCORED} SELECT count(*) AS pairs, count(*) FILTER (b.score > g.score) AS inverted, round(count(*) FILTER (b.score > g.score) / count(*), 6) AS rate FROM l g, l b WHERE g.good AND NOT b.good")
def inversion_rate(spark, d):
    return E.inversion_rate(scored(spark, d), "good", "score")


@query(f"{SWEEP} SELECT count(*) FILTER (v > b) AS violations FROM (SELECT precision AS v, lag(precision) OVER (ORDER BY threshold) AS b FROM w)")
def monotonicity_violations(spark, d):
    return E.increases(M.thresholds(scored(spark, d), "gold", "score"), "threshold", "precision")


VERDICT = "CASE WHEN score BETWEEN 0.4 AND 0.6 THEN 'abstain' WHEN score > 0.6 THEN 'yes' ELSE 'no' END"


@query(f"""WITH {SCORED}, v AS (SELECT CASE WHEN good THEN 'yes' ELSE 'no' END AS gold, {VERDICT} AS v FROM l), s AS (SELECT count(*) AS n, count(*) FILTER (v != 'abstain') AS d, count(*) FILTER (v = gold) AS k FROM v)
  SELECT n, round(d / n, 6) AS coverage, round(k / d, 6) AS decided_accuracy, round((k + (n - d) / 2) / n, 6) AS effective_accuracy FROM s""")
def decided_stats(spark, d):
    rows = scored(spark, d).select(F.when(F.col("good"), "yes").otherwise("no").alias("gold_verdict"), F.expr(VERDICT).alias("verdict"))
    return E.decided(rows, "gold_verdict", "verdict")


@query("SELECT quantile_disc(abs(c_acctbal), 0.95) AS critical FROM customer")
def empirical_critical(spark, d):
    return E.critical(table(spark, d, "customer"), "c_acctbal", 0.05)


@query("SELECT c_mktsegment, round(stddev_samp(c_acctbal), 6) AS sd, round(avg((c_acctbal > 0)::INT), 6) AS rate FROM customer GROUP BY 1")
def deviations(spark, d):
    """Sample standard deviation and the share of rows that satisfy a predicate."""
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(M.rounded(F.stddev_samp("c_acctbal"), "sd"), M.rounded(F.avg((F.col("c_acctbal") > 0).cast("double")), "rate"))


@query("SELECT min(p_size) FILTER (power >= 0.5) AS bonus FROM (SELECT p_size, avg((p_retailprice > 1400)::INT) AS power FROM part GROUP BY 1)")
def min_detectable(spark, d):
    power = table(spark, d, "part").groupBy("p_size").agg(F.avg((F.col("p_retailprice") > 1400).cast("double")).alias("power"))
    return E.detectable(power, "p_size", "power", 0.5)


@query(f"WITH {SCORED} SELECT lang, count(*) FILTER (score < 0.3) AS flagged, count(*) AS total FROM l GROUP BY 1")
def flag_rates(spark, d):
    return E.flag_rates(scored(spark, d), "lang", "score", 0.3)


@query(f"WITH {SCORED} SELECT round(avg(score) FILTER (good), 6) AS supported, round(avg(score) FILTER (NOT good), 6) AS unsupported FROM l")
def mean_score_by_support(spark, d):
    return E.means_by(scored(spark, d), "good", "score")


@query(f"""WITH {SCORED}, c AS (SELECT lang, count(*) FILTER (gold AND score >= 0.9) AS tp, count(*) FILTER (NOT gold AND score >= 0.9) AS fp, count(*) FILTER (gold AND score < 0.9) AS fn FROM l GROUP BY 1),
  a AS (SELECT * FROM c UNION ALL SELECT 'all', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c),
  p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM a)
  SELECT lang, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p""")
def finalized_counts(spark, d):
    """Counts by language, merged into one more row, and finalized."""
    g, s = F.col("gold"), F.col("score") >= 0.9
    by = scored(spark, d).groupBy("lang").agg(F.count_if(g & s).alias("tp"), F.count_if(~g & s).alias("fp"), F.count_if(g & ~s).alias("fn"))
    return E.finalized(by.unionByName(E.added(by.drop("lang")).select(F.lit("all").alias("lang"), "tp", "fp", "fn")))


@query("""WITH n AS (SELECT p_size AS s, count(*) AS n FROM part GROUP BY 1), f AS (SELECT regr_slope(ln(n), ln(s)) AS e, max(s) AS s, arg_max(n, s) AS v FROM n)
  SELECT round(e, 6) AS exponent, round(v * pow(1000.0::DOUBLE / s, e), 3) AS projected FROM f""")
def projected_size(spark, d):
    n = table(spark, d, "part").groupBy(F.col("p_size").alias("s")).agg(F.count("*").alias("n"))
    return E.projected(n, "s", "n", 1000)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def timing_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(M.rounded(F.avg("value"), "mean"), M.rounded(F.percentile("value", 0.95), "p95"))


@query(f"""WITH {SCORED}, f AS (SELECT CASE WHEN good THEN 'right' ELSE 'wrong' END AS outcome, score FROM l)
  SELECT CASE WHEN grouping(outcome) = 1 THEN 'pooled' ELSE outcome END AS outcome, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS most FROM f GROUP BY ROLLUP (outcome)""")
def outcome_split(spark, d):
    return E.fractions(scored(spark, d).select(F.when(F.col("good"), "right").otherwise("wrong").alias("outcome"), "score"), "outcome", "score")


@query("SELECT event_type, max(n) AS most FROM (SELECT event_type, epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def simultaneous_events(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3_600_000).alias("h"))
    return E.simultaneous(e, "event_type", "h")


@query("SELECT event_type, count(*) FILTER (value >= 10 AND value < 20) AS n FROM events GROUP BY 1")
def counts_in_range(spark, d):
    return E.in_range(table(spark, d, "events"), "event_type", "value", 10, 20)


@query("SELECT min(p_size) FILTER (m < 1400) AS rate FROM (SELECT p_size, avg(p_retailprice) AS m FROM part GROUP BY 1)")
def first_rate_below(spark, d):
    return E.first_below(table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("m")), "p_size", "m", 1400)


# rankings ----------------------------------------------------------------------------------------------------

RANKED = f"WITH {P.BASE}, {P.BM25}, {P.TFIDF}, {P.SHINGLES}"
FUSED = """rf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM
  (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM tm) GROUP BY ALL))"""


def systems(spark, d):
    c = P.corpus(spark, d)
    a, b = R.bm25(*c, k=None), R.tfidf(*c, k=None)
    return {"bm25": a, "tfidf": b, "rrf": R.rrf([a, b])}, P.relevant(*c)


def per_query(spark, d):
    found, rel = systems(spark, d)
    out = None
    for name, ranking in found.items():
        part = R.query_metrics(ranking, rel).withColumn("system", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def rr_rows(names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS system, query_id, recall, rr FROM {P.metric_sql(t)}" for s, t in names.items())


ALL = {"bm25": "bm", "tfidf": "tm", "rrf": "rf"}


@query(f"""{RANKED}, {FUSED}, r AS ({rr_rows(ALL)}), s AS (SELECT query_id, max((system = 'rrf' AND rr = 1)::INT) AS f, max((system = 'bm25' AND rr = 1)::INT) + max((system = 'tfidf' AND rr = 1)::INT) AS n FROM r GROUP BY 1)
  SELECT count(*) FILTER (f = 0 AND n > 0) AS missed, count(*) FILTER (f = 1 AND n = 0) AS recovered, count(*) FILTER (n = 1) AS sole_first, count(*) FILTER (n = 1 AND f = 1) AS kept FROM s""")
def fusion_attribution(spark, d):
    return E.attribution(per_query(spark, d), "rrf", ("bm25", "tfidf"))


@query(f"""{RANKED}, {FUSED}, r AS ({rr_rows(ALL)}), c AS (SELECT system, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, recall, rr FROM r)
  SELECT system, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS n, round(avg(recall), 5) AS recall, round(avg(rr), 5) AS mrr FROM c GROUP BY GROUPING SETS ((system, category), (system))""")
def metrics_by_category(spark, d):
    """Means by system and category of queries, and over all categories: grouping sets in one pass."""
    rows = per_query(spark, d).withColumn("category", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    t = rows.groupingSets([["system", "category"], ["system"]], "system", "category").agg(
        F.grouping("category").alias("g"), F.count("*").alias("n"), M.rounded(F.avg("recall"), "recall", 5), M.rounded(F.avg("rr"), "mrr", 5)
    )
    return t.select("system", F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n", "recall", "mrr")


@query(f"""WITH {P.BASE}, {P.BM25}, {P.TFIDF}, {{FUSED}}, {P.SHINGLES}, al AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS alpha),
      s AS (SELECT alpha, query_id, doc_id, round(alpha * a + (1 - alpha) * b, 6) AS score FROM wf, al),
      r AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, doc_id) AS rank FROM s),
      f AS (SELECT alpha, query_id, min(rank) AS first FROM r JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY ALL),
      m AS (SELECT alpha, round(avg(round(coalesce(1 / first, 0), 6)), 5) AS mrr FROM (SELECT DISTINCT query_id, alpha FROM rel, al) LEFT JOIN f USING (alpha, query_id) GROUP BY alpha)
      SELECT alpha, mrr FROM m WHERE mrr >= (SELECT max(mrr) FROM m) - 1e-12""".replace("{FUSED}", P.FUSED))
def best_alphas(spark, d):
    return E.best_of(P.sweep_alpha(spark, d), "alpha", "mrr")


@query(f"""WITH {P.BASE}, h AS (SELECT query_id, term, count(*) AS c FROM p JOIN q USING (term) GROUP BY ALL) SELECT round(avg(round(m / s, 6)), 5) AS head_term_share FROM (SELECT query_id, max(c) AS m, sum(c) AS s FROM h GROUP BY 1)""")
def head_term_share(spark, d):
    return R.query_work(*P.corpus(spark, d)).agg(M.rounded(F.avg(F.col("head_share")), "head_term_share", 5))


@query("SELECT quality, count(*) AS n, round(avg(toxic), 6) AS accuracy FROM labels GROUP BY 1")
def category_accuracy(spark, d):
    """Accuracy by category of outcomes."""
    return table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"), M.rounded(F.avg("toxic"), "accuracy"))
