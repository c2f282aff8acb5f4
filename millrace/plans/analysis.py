"""Queries on vectors, sketches, statistics, safety, conversations and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import context as C
from millrace.operators import dedup as N
from millrace.operators import safety as S
from millrace.operators import stats as M
from millrace.operators import vectors as V
from millrace.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# vectors -----------------------------------------------------------------------------------------------------

EM = "e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
KNN = f"""{EM}, c AS (SELECT q.vec_id AS query_id, b.vec_id, round(list_sum([(q.v[i] - b.v[i]) ** 2 for i in generate_series(1, len(q.v))]), 5) AS distance
  FROM e q, e b WHERE q.vec_id % 20 = 0), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM c)"""
I8 = f"""{EM}, i8 AS (SELECT vec_id, v, list_max([abs(x) for x in v]) / 127 AS scale, [CAST(greatest(-127, least(127, CASE WHEN list_max([abs(y) for y in v]) > 0 THEN round_even(x / (list_max([abs(y) for y in v]) / 127), 0) ELSE 0 END)) AS INT) for x in v] AS codes FROM e)"""


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {KNN} SELECT query_id, vec_id, distance, rank FROM k WHERE rank <= 10")
def knn_exact(spark, d):
    return V.exact_knn(*vectors(spark, d))


@query(f"WITH {I8} SELECT vec_id, round(scale, 9) AS scale, array_to_string(codes, ',') AS codes FROM i8")
def int8_codes(spark, d):
    return V.int8(vectors(spark, d)[0]).select("vec_id", F.round("scale", 9).alias("scale"), F.array_join("codes", ",").alias("codes"))


@query(f"WITH {I8} SELECT vec_id, round(sqrt(list_sum([(v[i] - codes[i] * scale) ** 2 for i in generate_series(1, len(v))]) / len(v)), 6) AS rmse FROM i8")
def int8_rmse(spark, d):
    e = vectors(spark, d)[0]
    return V.rmse(e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), V.int8_decoded(V.int8(e)))


GRID = f"""{EM}, cell AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e),
  g AS (SELECT dim, min(x) AS lo, (max(x) - min(x)) / 15 AS step FROM cell GROUP BY dim),
  gc AS (SELECT vec_id, list(CAST(greatest(0, least(15, CASE WHEN step > 0 THEN round_even((x - lo) / step, 0) ELSE 0 END)) AS INT) ORDER BY dim) AS codes FROM cell JOIN g USING (dim) GROUP BY vec_id)"""


@query(f"WITH {GRID} SELECT CAST(dim AS INT) AS dim, round(lo, 6) AS lo, round(step, 6) AS step FROM g")
def grid_fit(spark, d):
    return V.grid(vectors(spark, d)[0], 16).select("dim", F.round("lo", 6).alias("lo"), F.round("step", 6).alias("step"))


@query(f"WITH {GRID} SELECT vec_id, array_to_string(codes, ',') AS codes, array_to_string([codes[2 * i + 1] + 16 * coalesce(codes[2 * i + 2], 0) for i in generate_series(0, (len(codes) - 1) // 2)], ',') AS bytes FROM gc")
def grid_int4(spark, d):
    c = V.grid_codes(vectors(spark, d)[0], 16)
    back = V.unpacked(V.packed(F.col("codes")), F.size("codes"))
    c = c.select("vec_id", back.alias("back"), V.packed(F.col("codes")).alias("pairs"))
    return c.select("vec_id", F.array_join("back", ",").alias("codes"), F.array_join("pairs", ",").alias("bytes"))


@query(f"""WITH {KNN}, i AS (SELECT vec_id, list_max([abs(x) for x in v]) / 127 AS s, v FROM e), dec AS (SELECT vec_id, [greatest(-127, least(127, round_even(x / s, 0))) * s for x in v] AS w FROM i),
  c2 AS (SELECT q.vec_id AS query_id, b.vec_id, round(list_sum([(q.v[i] - b.w[i]) ** 2 for i in generate_series(1, len(q.v))]), 5) AS distance FROM e q, dec b WHERE q.vec_id % 20 = 0),
  k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM c2)
  SELECT query_id, round(sum(CASE WHEN k2.vec_id IS NULL THEN 0 ELSE 1 END) / count(*), 6) AS recall FROM (SELECT * FROM k WHERE rank <= 10) k LEFT JOIN (SELECT query_id, vec_id FROM k2 WHERE rank <= 10) k2 USING (query_id, vec_id) GROUP BY query_id""")
def int8_recall(spark, d):
    e, q = vectors(spark, d)
    return V.recall(V.exact_knn(V.int8_decoded(V.int8(e)), q), V.exact_knn(e, q))


# sketches ----------------------------------------------------------------------------------------------------

W = "regexp_extract_all(lower(replace(coalesce(text, ''), 'ß', 'ss')), '[\\p{L}\\p{N}]+')"
SH = f"""sh AS MATERIALIZED (SELECT DISTINCT doc_id, CAST('0x' || left(sha256(s), 15) AS BIGINT) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5
  THEN [array_to_string(w[i:i + 4], ' ') for i in generate_series(1, len(w) - 4)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT doc_id, {W} AS w FROM documents)))"""
def minhash_sql(k: int, r: int) -> str:
    """Signatures of k components, all pairs that agree in a band of r, their similarities."""
    return f"""{SH}, mh AS MATERIALIZED (SELECT doc_id, {', '.join(f'min(CAST((s::HUGEINT * {a} + {b}) % {N.P} AS BIGINT)) AS h{i}' for i, (a, b) in enumerate(N.coefficients(k)))} FROM sh GROUP BY doc_id),
  bk AS (SELECT doc_id, unnest([{', '.join("'" + str(b) + ":' || " + " || ':' || ".join(f"h{i}" for i in range(r * b, r * b + r)) for b in range(k // r))}]) AS key FROM mh),
  cand AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bk x JOIN bk y USING (key) WHERE x.doc_id < y.doc_id),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), every AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
  truth AS MATERIALIZED (SELECT a, b, round(c / (na.n + nb.n - c), 6) AS jaccard FROM every JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b)"""


MH = minhash_sql(16, 4)


def rows_of(spark, d):
    return N.shingle_sets(table(spark, d, "documents"))


@query(f"WITH {MH} SELECT * FROM mh")
def minhash_signatures(spark, d):
    return N.minhash(rows_of(spark, d))


@query(f"WITH {minhash_sql(48, 3)} SELECT a, b, jaccard FROM truth JOIN cand USING (a, b) WHERE jaccard >= 0.8")
def minhash_lsh_pairs(spark, d):
    rows = rows_of(spark, d)
    return N.similarities(N.candidates(N.minhash(rows, 48), 48, 3), rows).where("jaccard >= 0.8")  # 16 bands of 3: 0.99999 at 0.8


@query(f"WITH {MH} SELECT a, b, round(({' + '.join(f'CAST(x.h{i} = y.h{i} AS INT)' for i in range(16))}) / 16, 6) AS estimate FROM cand JOIN mh x ON x.doc_id = a JOIN mh y ON y.doc_id = b")
def jaccard_estimates(spark, d):
    m = N.minhash(rows_of(spark, d))
    return N.estimates(N.candidates(m), m)


@query(f"""WITH {MH}, t AS (SELECT a, b FROM truth WHERE jaccard >= 0.8), m AS (SELECT count(*) FILTER (t.a IS NOT NULL AND c.a IS NOT NULL) AS tp, count(*) FILTER (t.a IS NULL) AS fp, count(*) FILTER (c.a IS NULL) AS fn FROM cand c FULL JOIN t USING (a, b))
  SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m""")
def lsh_pair_scores(spark, d):
    return N.candidate_scores(rows_of(spark, d))


@query(f"WITH {SH} SELECT doc_id, CAST({' + '.join(f'(CASE WHEN sum(CASE WHEN (s >> {i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << i} ELSE 0 END)::BIGINT' for i in range(60))} AS BIGINT) AS simhash FROM sh GROUP BY doc_id")
def simhashes(spark, d):
    return N.simhash(rows_of(spark, d))


@query("SELECT round(i / 20, 6) AS s, round(1 - pow(1 - pow(i / 20, 4), 16), 6) AS p, round(pow(1 - pow(0.5, 1 / 16), 1 / 4), 6) AS halfway FROM generate_series(0, 20) t(i)")
def collision_curve(spark, d):
    return N.collision_curve(spark, 4, 16)


# statistics --------------------------------------------------------------------------------------------------

SCORED = """l AS MATERIALIZED (SELECT doc_id, toxic = 1 AS gold, quality = 1 AS good, round((n_chars % 997) / 996, 6) AS score, lang FROM labels JOIN documents USING (doc_id))"""


def scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    rows = table(spark, d, "labels").join(docs, "doc_id")
    return rows.select("doc_id", (F.col("toxic") == 1).alias("gold"), (F.col("quality") == 1).alias("good"), F.round(F.col("n_chars") % 997 / 996, 6).alias("score"), "lang")


@query(f"WITH {SCORED} SELECT count(*) FILTER (gold AND score >= 0.5) AS tp, count(*) FILTER (NOT gold AND score >= 0.5) AS fp, count(*) FILTER (gold AND score < 0.5) AS fn, count(*) FILTER (NOT gold AND score < 0.5) AS tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM l")
def binary_scores(spark, d):
    return M.binary_scores(scored(spark, d).withColumn("said", F.col("score") >= 0.5), "gold", "said")


@query(f"WITH {SCORED} SELECT round(sum(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc FROM l p, l n WHERE p.gold AND NOT n.gold")
def roc_auc(spark, d):
    return M.auc(scored(spark, d), "gold", "score")


SWEEP = f"""WITH {SCORED}, t AS (SELECT DISTINCT score AS threshold FROM l), s AS (SELECT threshold, count(*) FILTER (gold AND score >= threshold) AS tp, count(*) FILTER (NOT gold AND score >= threshold) AS fp FROM t, l GROUP BY threshold),
  n AS (SELECT count(*) FILTER (gold) AS p, count(*) FILTER (NOT gold) AS n FROM l),
  w AS (SELECT threshold, tp, fp, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(tp / p - fp / n, 6) AS youden FROM s, n)"""


@query(f"{SWEEP} SELECT * FROM w")
def threshold_sweep(spark, d):
    return M.thresholds(scored(spark, d), "gold", "score")


@query(f"{SWEEP} SELECT * FROM w ORDER BY youden DESC, threshold LIMIT 1")
def youden_best(spark, d):
    return M.youden_best(M.thresholds(scored(spark, d), "gold", "score"))


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c),
  e AS (SELECT sum(x * y) AS xy FROM (SELECT a AS c, sum(n)::DOUBLE AS x FROM c GROUP BY a) JOIN (SELECT b AS c, sum(n)::DOUBLE AS y FROM c GROUP BY b) USING (c))
  SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS agreement, round((same / n - xy / n / n) / (1 - xy / n / n), 6) AS kappa FROM t, e""")
def cohens_kappa(spark, d):
    return M.kappa(table(spark, d, "labels"), "quality", "toxic")


REL = f"{SCORED}, r AS (SELECT CAST(least(9, floor(score * 10)) AS INT) AS bin, count(*) AS n, round(avg(good::INT), 6) AS accuracy, round(avg(score), 6) AS confidence, round(abs(avg(good::INT) - avg(score)), 6) AS gap FROM l GROUP BY ALL)"


@query(f"WITH {REL} SELECT * FROM r")
def reliability_bins(spark, d):
    return M.reliability(scored(spark, d), "good", "score")


@query(f"WITH {REL} SELECT round(sum(n * gap) / sum(n), 5) AS ece, round(max(gap), 5) AS mce, (SELECT round(avg((score - good::INT) ** 2), 5) FROM l) AS brier FROM r")
def calibration(spark, d):
    return M.calibration(scored(spark, d), "good", "score")


RISK = f"{SCORED}, rc AS (SELECT CAST(row_number() OVER w AS INT) AS place, doc_id, round(row_number() OVER w / (SELECT count(*) FROM l), 6) AS coverage, round(sum((NOT good)::INT) OVER (w ROWS UNBOUNDED PRECEDING) / row_number() OVER w, 6) AS risk FROM l WINDOW w AS (ORDER BY score DESC, doc_id))"


@query(f"WITH {RISK} SELECT * FROM rc")
def risk_coverage(spark, d):
    return M.risk_coverage(scored(spark, d), "doc_id", "good", "score")


@query(f"WITH {RISK} SELECT round(avg(risk), 5) AS aurc, round(max(coverage) FILTER (risk <= 0.25), 6) AS coverage_at_risk FROM rc")
def aurc(spark, d):
    return M.aurc(M.risk_coverage(scored(spark, d), "doc_id", "good", "score"))


Z = M.Z95
WIL = f"""SELECT o_orderpriority, n, k, round(k / n, 6) AS share, round(greatest(0, (k / n + {Z * Z} / (2 * n) - {Z} * sqrt(k / n * (1 - k / n) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n)), 6) AS low,
  round(least(1, (k / n + {Z * Z} / (2 * n) + {Z} * sqrt(k / n * (1 - k / n) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n)), 6) AS high FROM (SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_orderstatus = 'F' AS INT)) AS BIGINT) AS k FROM orders GROUP BY 1)"""


@query(WIL)
def wilson(spark, d):
    return M.wilson(table(spark, d, "orders").withColumn("hit", F.col("o_orderstatus") == "F"), "o_orderpriority", "hit")


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.95), 6) AS q95 FROM orders GROUP BY 1")
def quantiles(spark, d):
    return M.quantiles(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, quality - 0.5 AS v FROM labels), n AS (SELECT count(*) AS n FROM i),
  m AS (SELECT round_, round(avg(v), 9) AS m FROM (SELECT r AS round_, CAST('0x' || left(md5(r || '-' || i), 8) AS BIGINT) % n AS k FROM i, n, generate_series(0, 499) t(r)) JOIN (SELECT i AS k, v FROM i) USING (k) GROUP BY round_)
  SELECT (SELECT round(avg(v), 6) FROM i) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg((m <= 0)::INT), 6) AS p_le_zero, round(avg((m >= 0)::INT), 6) AS p_ge_zero FROM m""")
def bootstrap_ci(spark, d):
    rows = table(spark, d, "labels").select("doc_id", (F.col("quality") - 0.5).alias("v"), F.lit(1).cast("long").alias("one"))
    return M.bootstrap(M.running(rows, ["doc_id"], {"one": "upto"}).select((F.col("upto") - 1).alias("i"), "v"), "v")


PS = "ps AS (SELECT CAST(p_size AS VARCHAR) AS k, round((p_size * 7919 % 1000) / 10000, 6) AS p FROM (SELECT DISTINCT p_size FROM part))"


@query(f"WITH {PS}, r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS place, count(*) OVER () AS m FROM ps) SELECT k, p, CAST(place AS INT) AS place, place <= coalesce((SELECT max(place) FROM r WHERE p <= 0.05 * place / m), 0) AS rejected FROM r")
def benjamini_hochberg(spark, d):
    rows = table(spark, d, "part").select("p_size").distinct().select(F.col("p_size").cast("string").alias("k"), F.round(F.col("p_size") * 7919 % 1000 / 10000, 6).alias("p"))
    return M.benjamini_hochberg(rows, "k", "p")


@query(f"""WITH {SCORED}, t AS (SELECT lang, count(*) AS n, avg(good::INT - gold::INT) AS delta, count(*) FILTER (good::INT < gold::INT) AS lost, count(*) FILTER (good::INT > gold::INT) AS won FROM l GROUP BY lang),
  p AS (SELECT *, round(1 / (1 + exp(1.702 * (lost - won - 1) / sqrt(greatest(1, lost + won)))), 6) AS p, count(*) OVER () AS m FROM t), r AS (SELECT *, row_number() OVER (ORDER BY p, lang) AS place FROM p)
  SELECT lang, n, round(delta, 6) AS delta, lost, won, p, delta < -0.02 AS naive, p <= 0.025 / m AS bonferroni, place <= coalesce((SELECT max(place) FROM r WHERE p <= 0.025 * place / m), 0) AS bh FROM r""")
def slice_gates(spark, d):
    return M.gates(scored(spark, d), "lang", "gold", "good")


@query("SELECT round(regr_slope(ln(n), ln(bin)), 6) AS exponent FROM (SELECT least(n_chars // 100, 50) + 1 AS bin, count(*) AS n FROM documents GROUP BY 1)")
def growth_exponent(spark, d):
    rows = table(spark, d, "documents").groupBy((F.least(F.floor(F.col("n_chars") / 100), F.lit(50)) + 1).alias("bin")).agg(F.count("*").alias("n"))
    return M.growth(rows, "bin", "n")


@query("""WITH x AS (SELECT vec_id, [embedding[i]::DOUBLE for i in generate_series(1, 4)] AS z FROM embeddings), e AS (SELECT vec_id, [exp(v - list_max(z)) for v in z] AS e FROM x), p AS (SELECT vec_id, [v / list_sum(e) for v in e] AS p FROM e)
  SELECT vec_id, round(list_max(p), 6) AS confidence, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin, round(list_sum([v * ln(v) for v in p]), 6) AS neg_entropy FROM p""")
def confidence_signals(spark, d):
    z = table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("z"))
    return z.select("vec_id", M.softmax(F.col("z")).alias("p")).select("vec_id", *M.signals(F.col("p")))


# safety ------------------------------------------------------------------------------------------------------

@query(None)  # what stands around a candidate and entropy decide
def pii_counts(spark, d):
    return S.pii_counts(table(spark, d, "documents"))


@query(None)  # overlaps and numbered labels; held against brute force
def redaction(spark, d):
    return S.redacted(table(spark, d, "documents"))


RULE = [(n, w, f"regexp_matches(lower(coalesce(text, '')), '{p}')") for n, w, p in S.RULES]


@query(f"SELECT doc_id, {' + '.join(f'CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END' for _, w, c in RULE)} AS score, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, _, c in RULE)}], lambda x: x IS NOT NULL)), ',') AS rules FROM documents")
def injection_score(spark, d):
    """Its SQL reads lower-case texts; these tables hide nothing that normalisation or base64 would bring out."""
    return S.injection_score(table(spark, d, "documents"))


# conversations and events ------------------------------------------------------------------------------------

AC = "ac AS (SELECT conv_id, turn, role, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS tokens FROM conversations), a AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM ac)"


@query(f"WITH {AC} SELECT * FROM a")
def token_accounts(spark, d):
    return C.accounts(table(spark, d, "conversations"))


@query(f"WITH {AC} SELECT conv_id, CAST(sum(so_far - tokens) AS BIGINT) AS tokens_in, CAST(sum(tokens) AS BIGINT) AS tokens_out, round((sum(so_far - tokens) * 3.0::DOUBLE + sum(tokens) * 15.0::DOUBLE) / 1000000, 9) AS usd FROM a WHERE role = 'assistant' GROUP BY conv_id")
def conversation_prices(spark, d):
    return C.prices(table(spark, d, "conversations"))


@query(f"""WITH {AC}, p AS (SELECT conv_id, tokens, so_far - tokens AS pre, coalesce(lag(so_far - tokens) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS before FROM a WHERE role = 'assistant')
  SELECT conv_id, round((sum(before * 0.1::DOUBLE + (pre - before) * 1.25::DOUBLE) * 3 + sum(tokens) * 15) / 1000000, 9) AS usd FROM p GROUP BY conv_id""")
def price_trace(spark, d):
    return C.incremental(table(spark, d, "conversations"))


@query(f"WITH {AC}, s AS (SELECT conv_id, turn, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cost FROM ac) SELECT * FROM s WHERE cost <= 300")
def sliding_window(spark, d):
    return C.sliding(table(spark, d, "conversations"))


@query(f"""WITH {AC}, p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM ac), s AS (SELECT conv_id, turn, place, sum(CASE WHEN place > 1 THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)
  + sum(CASE WHEN place <= 1 THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS cost FROM p) SELECT conv_id, turn FROM s WHERE place <= 1 OR cost <= 300""")
def head_and_tail(spark, d):
    return C.head_and_tail(table(spark, d, "conversations"))


@query("""WITH b AS (SELECT conv_id, turn, sha256(role || ': ' || coalesce(text, '')) AS d FROM conversations), w AS (SELECT conv_id, turn, list(d) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS l FROM b)
  SELECT conv_id, turn, CAST(len(l) AS INT) AS blocks, sha256(array_to_string(l, '')) AS digest FROM w""")
def request_prefixes(spark, d):
    return C.prefixes(table(spark, d, "conversations"))


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH w AS (SELECT DISTINCT conv_id, turn, w FROM (SELECT conv_id, turn, unnest({W}) AS w FROM conversations) WHERE w NOT IN ({STOP})), s AS (SELECT conv_id, w, count(DISTINCT turn) AS sf FROM w GROUP BY ALL), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
  SELECT conv_id, turn, round(avg(ln(n / sf)), 6) + 0.0 AS score FROM w JOIN s USING (conv_id, w) JOIN n USING (conv_id) GROUP BY ALL""")
def salience_rarity(spark, d):
    return C.rarity(table(spark, d, "conversations"))


@query("SELECT event_type, max(n) AS peak FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN CURRENT ROW AND 3599999 FOLLOWING) AS n FROM events) GROUP BY 1")
def peak_window(spark, d):
    return C.peak_windows(table(spark, d, "events"), "event_type", 3_600_000)


@query("""WITH e AS (SELECT epoch_us(ts) // 1000 AS ms, value FROM events), l AS (SELECT min(ms) AS lo, max(ms) AS hi FROM e), b AS (SELECT unnest(generate_series(0, (hi - lo) // 86400000)) AS bin FROM l),
  g AS (SELECT (ms - lo) // 86400000 AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM e, l GROUP BY 1) SELECT bin, coalesce(n, 0) AS n, mean FROM b LEFT JOIN g USING (bin)""")
def timeline(spark, d):
    return C.timeline(table(spark, d, "events"), 86_400_000)


@query("""SELECT event_id, count(*) OVER w AS volume, round(sum(CAST(value < 10 AS INT)) OVER w / count(*) OVER w, 6) AS rate FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW)""")
def rolling_error_rate(spark, d):
    return C.rolling_rate(table(spark, d, "events"), "event_type", F.col("value") < 10, 86_400_000)


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events), n AS (SELECT *, coalesce((ms - lag(ms) OVER w > 21600000)::INT, 0) AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
  s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n) SELECT user_id, session, count(*) AS n, min(ms) AS first, max(ms) AS last FROM s GROUP BY ALL""")
def sessions(spark, d):
    return C.sessions(table(spark, d, "events"), "user_id", 21_600_000)
