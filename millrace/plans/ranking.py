"""Queries on pruned retrieval, reranking, rewriting, two hops, quantised search, gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators import gates as G
from millrace.operators import pruned
from millrace.operators import rerank as K
from millrace.operators import retrieval as R
from millrace.operators import vectors as V
from millrace.plans import retrieval as P
from millrace.plans.analysis import KNN, SCORED, scored, vectors
from millrace.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOP = P.ORACLES["bm25_topk"]
RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY {0}) AS INT) AS rank"


@query(TOP)
def wand_topk(spark, d):
    return pruned.wand(*P.corpus(spark, d))


@query(TOP)
def maxscore_topk(spark, d):
    return pruned.maxscore(*P.corpus(spark, d))


@query(TOP)
def block_max_topk(spark, d):
    return pruned.block_max(*P.corpus(spark, d))


GAIN = f"""{P.BASE}, ga AS MATERIALIZED (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl)) AS gain
  FROM p JOIN (SELECT DISTINCT term FROM q) USING (term) JOIN df USING (term) JOIN dl USING (doc_id), tot)"""


@query(f"""WITH {GAIN} SELECT term, count(*) AS df, round(max(gain), 6) AS bound, round(coalesce(list_reverse_sort(list(gain))[10], 0), 6) AS kth FROM ga GROUP BY 1""")
def term_bounds(spark, d):
    return pruned.bounds(pruned.gains(*P.corpus(spark, d))).select("term", "df", F.round("bound", 6).alias("bound"), F.round("kth", 6).alias("kth"))


@query(f"WITH {GAIN} SELECT term, doc_id // 64 AS block, max(doc_id) AS last, round(max(gain), 6) AS bound FROM ga GROUP BY ALL")
def block_bounds(spark, d):
    return pruned.blocks(pruned.gains(*P.corpus(spark, d))).select("term", "block", "last", F.round("bound", 6).alias("bound"))


@query(f"WITH {P.BASE} SELECT query_id, CAST(count(*) AS BIGINT) AS postings FROM p JOIN q USING (term) GROUP BY 1")
def pruned_work(spark, d):
    """Postings of each query; the share that is scored is in pruned.work."""
    return pruned.work(*P.corpus(spark, d)).where("scored <= postings").select("query_id", "postings")


@query(f"WITH {P.BASE}, {P.BM25}, k AS (SELECT query_id FROM bm WHERE rank <= 10 GROUP BY 1) SELECT count(*) AS n, count(*) AS identical FROM k")
def identical_rankings(spark, d):
    """Queries for which flat and pruned search give the same list: all."""
    c = P.corpus(spark, d)
    return E.identical(R.bm25(*c), pruned.maxscore(*c))


# second stages -----------------------------------------------------------------------------------------------

SHORT = f"WITH {P.BASE}, {P.BM25}, {P.TFIDF}, sl AS (SELECT query_id, doc_id, rank FROM tm WHERE rank <= 20)"


@query(f"""{SHORT}, v AS (SELECT sl.*, coalesce(bs.score, 0) AS value FROM sl LEFT JOIN bs USING (query_id, doc_id))
  SELECT query_id, doc_id, {RANK.format("(rank > 10)::INT, CASE WHEN rank <= 10 THEN -value END, rank")} FROM v""")
def bm25_reranked(spark, d):
    docs, q = P.corpus(spark, d)
    short = R.tfidf(docs, q, 20)
    return K.reranked(short, K.bm25_values(short, docs, q), 10)


@query(f"""{SHORT}, {P.SHINGLES}, v AS (SELECT sl.*, (rel.doc_id IS NOT NULL)::INT AS value FROM sl LEFT JOIN rel USING (query_id, doc_id))
  SELECT query_id, doc_id, {RANK.format("-value, rank")} FROM v""")
def oracle_reranked(spark, d):
    docs, q = P.corpus(spark, d)
    short = R.tfidf(docs, q, 20)
    return K.reranked(short, K.oracle_values(short, P.relevant(docs, q)), 20)


@query(f"""{SHORT}, {P.SHINGLES}, b AS (SELECT query_id, min(rank) AS x FROM sl JOIN rel USING (query_id, doc_id) GROUP BY 1)
  SELECT count(*) AS n, count(*) FILTER (x > 1) AS promoted, 0::BIGINT AS demoted, count(*) FILTER (x = 1) AS same FROM b""")
def rerank_moves(spark, d):
    docs, q = P.corpus(spark, d)
    short, rel = R.tfidf(docs, q, 20), P.relevant(docs, q)
    return K.moved(short, K.reranked(short, K.oracle_values(short, rel), 20), rel)


@query(f"""{SHORT}, v AS (SELECT sl.query_id, bs.score FROM sl JOIN bs USING (query_id, doc_id)), c AS (SELECT query_id, max(score) AS c FROM bs GROUP BY 1)
  SELECT query_id, count(*) FILTER (abs(score - c) <= 1e-9) AS hits FROM v JOIN c USING (query_id) GROUP BY 1""")
def ceiling_hits(spark, d):
    docs, q = P.corpus(spark, d)
    short = R.tfidf(docs, q, 20)
    top = R.bm25(docs, q, 1).select("query_id", F.col("score").alias("ceiling"))
    return K.ceiling(K.bm25_values(short, docs, q), top)


@query(None)  # an eigenvector problem
def lsa_topk(spark, d):
    return K.lsa(*P.corpus(spark, d))


@query(None)
def lsa_reranked(spark, d):
    docs, q = P.corpus(spark, d)
    short = R.bm25(docs, q, 20)
    return K.reranked(short, K.pooled_values(short, docs, q, K.term_space(docs)), 20)


@query(None)
def maxsim_reranked(spark, d):
    docs, q = P.corpus(spark, d)
    short = R.bm25(docs, q, 20)
    return K.reranked(short, K.maxsim_values(short, docs, q, K.term_space(docs)), 20)


@query(f"""WITH {KNN}, dec AS (SELECT vec_id, v, list_max([abs(x) for x in v]) / 127 AS s FROM e), w AS (SELECT vec_id, [greatest(-127, least(127, round_even(x / s, 0))) * s for x in v] AS w FROM dec),
  c2 AS (SELECT q.vec_id AS query_id, b.vec_id, round(list_sum([(q.v[i] - b.w[i]) ** 2 for i in generate_series(1, len(q.v))]), 5) AS distance FROM e q, w b WHERE q.vec_id % 20 = 0),
  s AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM c2) WHERE r <= 40)
  SELECT * FROM (SELECT query_id, vec_id, distance, {RANK.format("distance, vec_id")} FROM c JOIN s USING (query_id, vec_id)) WHERE rank <= 10""")
def quantised_rerank(spark, d):
    e, q = vectors(spark, d)
    return K.search_with_rerank(e, V.int8_decoded(V.int8(e)), q)


# rewriting and hops ------------------------------------------------------------------------------------------

BM_OF = "round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM p JOIN {0} USING (term) JOIN df USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL"


def answers(spark, d):
    """A hypothetical answer of each third item: the text of the document of its number."""
    return table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"))


def hyde_sql(append: bool) -> str:
    text = "concat_ws(' ', b.text, a.text)" if append else "coalesce(a.text, b.text)"
    return f"""WITH {P.BASE}, hq AS (SELECT DISTINCT query_id, unnest({P.D}) AS term FROM (SELECT b.item_id AS query_id, {text} AS text FROM benchmark b LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) a ON a.doc_id = b.item_id)),
      s AS (SELECT query_id, doc_id, {BM_OF.format("hq")}) SELECT * FROM (SELECT query_id, doc_id, score, {RANK.format("score DESC, doc_id")} FROM s WHERE score > 0) WHERE rank <= 10"""


@query(hyde_sql(True))
def hyde_append(spark, d):
    docs, q = P.corpus(spark, d)
    return R.bm25(docs, K.hypothetical(q, answers(spark, d)))


@query(hyde_sql(False))
def hyde_replace(spark, d):
    docs, q = P.corpus(spark, d)
    return R.bm25(docs, K.hypothetical(q, answers(spark, d), append=False))


@query("SELECT doc_id AS query_id, CASE WHEN row_number() OVER (ORDER BY md5('7-' || doc_id), doc_id) > round(0.3::DOUBLE * count(*) OVER ()) THEN md5(text) END AS digest FROM documents WHERE doc_id % 3 = 0")
def failing_answers(spark, d):
    return K.failing(answers(spark, d), 0.3, 7).select("query_id", F.md5(F.col("answer").cast("binary")).alias("digest"))


ITERATIVE = f"""WITH {P.BASE}, {P.BM25}, {P.BRIDGE}, q2 AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, term FROM q UNION ALL SELECT query_id, term FROM br)),
  s2 AS (SELECT query_id, doc_id, {BM_OF.format("q2")}), r2 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s2 WHERE score > 0),
  u AS (SELECT query_id, doc_id, min(place) AS place FROM (SELECT query_id, doc_id, 2 * rank - 1 AS place FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 2 * rank FROM r2 WHERE rank <= 10) GROUP BY ALL),
  it AS (SELECT query_id, doc_id, {RANK.format("place")} FROM u)"""


@query(f"{ITERATIVE} SELECT * FROM it WHERE rank <= 10")
def iterative_search(spark, d):
    return K.iterative(*P.corpus(spark, d))


@query(f"""{ITERATIVE}, {P.SHINGLES}, bd AS (SELECT query_id, doc_id FROM bm WHERE rank = 2), t AS (SELECT * FROM it WHERE rank <= 10),
  a AS (SELECT query_id, min(rank) AS a FROM t JOIN rel USING (query_id, doc_id) GROUP BY 1), b AS (SELECT query_id, min(rank) AS b FROM t JOIN bd USING (query_id, doc_id) GROUP BY 1)
  SELECT query_id, round(CASE WHEN a IS NULL THEN 0 ELSE 1 / a END, 6) AS rr, coalesce(a <= 1, false) AS hit1, coalesce(a <= 5, false) AS hit5, coalesce(a <= 5, false) AND coalesce(b <= 5, false) AS pair5
  FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)""")
def hop_scores(spark, d):
    docs, q = P.corpus(spark, d)
    bridge = R.bm25(docs, q).where("rank = 2")
    return K.hops(K.iterative(docs, q), P.relevant(docs, q), bridge)


# gates -------------------------------------------------------------------------------------------------------

PAIRED = f"""{SCORED}, o AS (SELECT doc_id AS item, lang AS slice, gold::INT AS old, good::INT AS new FROM l),
  r AS MATERIALIZED (SELECT slice, new - old AS v, row_number() OVER (PARTITION BY slice ORDER BY item) - 1 AS i, count(*) OVER (PARTITION BY slice) AS n FROM (SELECT * FROM o UNION ALL SELECT item, '*', old, new FROM o)),
  m AS (SELECT slice, t.round_, round(sum(x.v) / any_value(x.n), 9) AS m FROM (SELECT slice, n, round_, CAST('0x' || left(md5(round_ || '-' || slice || '-' || i), 8) AS BIGINT) % n AS k FROM r, generate_series(0, 199) s(round_)) t JOIN r x USING (slice) WHERE x.i = t.k GROUP BY ALL),
  g AS MATERIALIZED (SELECT slice, n, delta, low, high, p FROM (SELECT slice, count(*) AS n, round(avg(v), 6) AS delta FROM r GROUP BY 1)
    JOIN (SELECT slice, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg((m >= 0)::INT), 6) AS p FROM m GROUP BY 1) USING (slice))"""


def outcomes(spark, d):
    return scored(spark, d).select(F.col("doc_id").alias("item"), F.col("lang").alias("slice"), F.col("gold").cast("int").alias("old"), F.col("good").cast("int").alias("new"))


@query(f"WITH {PAIRED} SELECT * FROM g")
def paired_intervals(spark, d):
    return G.resampled(outcomes(spark, d))


@query(f"""WITH {PAIRED}, s AS (SELECT *, row_number() OVER (ORDER BY p, slice) AS place, count(*) OVER () AS m FROM g WHERE slice != '*'), w AS (SELECT delta < -0.02 AS naive, high < 0 AS ci FROM g WHERE slice = '*'),
  b AS (SELECT coalesce(bool_or(high < 0), false) AS slice, coalesce(min(p) <= 0.025 / count(*), false) AS bonferroni, coalesce(bool_or(p <= 0.025 * place / m), false) AS bh FROM s)
  SELECT naive, ci, slice, ci OR slice AS combined, bonferroni, bh, ci OR bh AS combined_bh FROM w, b""")
def gate_verdicts(spark, d):
    return G.verdicts(G.resampled(outcomes(spark, d)))


@query(f"""WITH {SCORED} SELECT CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS slice, count(*) AS n, round(avg(gold::INT), 6) AS old, round(avg(good::INT), 6) AS new,
  count(*) FILTER (good::INT > gold::INT) AS improved, count(*) FILTER (good::INT < gold::INT) AS regressed FROM l GROUP BY ROLLUP (lang)""")
def run_changes(spark, d):
    o = outcomes(spark, d)
    old, new = o.select("item", "slice", F.col("old").alias("ok")), o.select("item", F.col("new").alias("ok"))
    return G.changes(G.compared(old, new))


@query("SELECT doc_id, CAST(CAST('0x' || left(sha256('seed' || chr(31) || doc_id), 16) AS UHUGEINT) AS DECIMAL(20,0)) AS u FROM labels")
def stable_numbers(spark, d):
    return table(spark, d, "labels").select("doc_id", G.stable_u64(F.lit("seed"), F.col("doc_id").cast("string")).alias("u"))
