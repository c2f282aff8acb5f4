"""Queries on retrieval and text functions over documents and benchmark, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval as R
from millrace.sources.tables import table


def corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


FOLD = "lower(replace(coalesce({0}, ''), 'ß', 'ss'))"
WORDS = "regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}]+')"
D, Q = WORDS.format("text"), WORDS.format("text")
BASE = f"""
dt AS MATERIALIZED (SELECT doc_id, unnest({D}) AS term FROM documents),
qt AS MATERIALIZED (SELECT item_id AS query_id, unnest({Q}) AS term FROM benchmark),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
q AS MATERIALIZED (SELECT DISTINCT query_id, term FROM qt),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM p GROUP BY term),
dl AS MATERIALIZED (SELECT doc_id, len({D}) AS dl FROM documents),
tot AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM dl)"""
BM25 = """
bs AS MATERIALIZED (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
  FROM p JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL),
bm AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM bs WHERE score > 0)"""
TFIDF = """
dw AS MATERIALIZED (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM p JOIN df USING (term), tot),
qw AS MATERIALIZED (SELECT query_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY ALL) JOIN df USING (term), tot),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY doc_id), qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY query_id),
ts AS MATERIALIZED (SELECT query_id, doc_id, round(sum(dw.w * qw.w) / (any_value(dn) * any_value(qn)), 6) AS score FROM dw JOIN qw USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY ALL),
tm AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM ts WHERE score > 0)"""
SHINGLES = """
sd AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in generate_series(1, len(w) - 4)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT doc_id, {D} AS w FROM documents)),
sq AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in generate_series(1, len(w) - 4)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT item_id AS query_id, {D} AS w FROM benchmark)),
con AS MATERIALIZED (SELECT query_id, doc_id, round(count(*) / any_value(size), 6) AS share FROM sd JOIN sq USING (s) JOIN (SELECT query_id, count(*) AS size FROM sq GROUP BY query_id) USING (query_id) GROUP BY ALL),
rel AS MATERIALIZED (SELECT query_id, doc_id FROM con WHERE share >= 0.5)""".replace("{D}", D)


def metric_sql(ranking: str) -> str:
    return f"""(SELECT query_id, round(coalesce(hits, 0) / n, 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr
      FROM (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id)
      LEFT JOIN (SELECT query_id, count(*) AS hits, min(rank) AS first FROM {ranking} JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id) USING (query_id))"""


def relevant(docs: DataFrame, items: DataFrame) -> DataFrame:
    return R.containment(docs, items).where("share >= 0.5").select("query_id", "doc_id")


def bm25_topk(spark, d):
    return R.bm25(*corpus(spark, d))


def tfidf_topk(spark, d):
    return R.tfidf(*corpus(spark, d))


def rrf_fusion(spark, d):
    c = corpus(spark, d)
    return R.rrf([R.bm25(*c, k=None), R.tfidf(*c, k=None)])


def weighted_fusion(spark, d):
    c = corpus(spark, d)
    return R.weighted_fusion(R.bm25(*c, k=None), R.tfidf(*c, k=None))


def interleave(spark, d):
    c = corpus(spark, d)
    return R.interleave(R.bm25(*c), R.tfidf(*c))


def bridge_terms(spark, d):
    docs, q = corpus(spark, d)
    return R.feedback_terms(docs, q, R.bm25(docs, q, 1))


def prf_expand(spark, d):
    docs, q = corpus(spark, d)
    return R.bm25(docs, R.expanded(q, R.feedback_terms(docs, q, R.bm25(docs, q, 1))))


def containment(spark, d):
    return R.containment(*corpus(spark, d))


def recall_mrr(spark, d):
    c = corpus(spark, d)
    return R.query_metrics(R.bm25(*c), relevant(*c))


def mean_metrics(spark, d):
    c = corpus(spark, d)
    rel, out = relevant(*c), None
    for name, ranking in (("bm25", R.bm25(*c)), ("tfidf", R.tfidf(*c))):
        part = R.query_metrics(ranking, rel).agg(F.lit(name).alias("system"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg("rr"), 5).alias("mrr"))
        out = part if out is None else out.unionByName(part)
    return out


def head_to_head(spark, d):
    c = corpus(spark, d)
    rel = relevant(*c)
    return R.head_to_head(R.query_metrics(R.bm25(*c), rel), R.query_metrics(R.tfidf(*c), rel))


def sweep_alpha(spark, d):
    c = corpus(spark, d)
    a, b, rel, out = R.bm25(*c, k=None), R.tfidf(*c, k=None), relevant(*c), None
    for alpha in (0.0, 0.25, 0.5, 0.75, 1.0):
        part = R.query_metrics(R.weighted_fusion(a, b, alpha), rel).agg(F.lit(alpha).alias("alpha"), F.round(F.avg("rr"), 5).alias("mrr"))
        out = part if out is None else out.unionByName(part)
    return out


def query_work(spark, d):
    return R.query_work(*corpus(spark, d))


def term_stats(spark, d):
    docs, _ = corpus(spark, d)
    return R.postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def text_measures(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", T.word_count(t).alias("n_words"), T.squashed(t).alias("squashed"), T.folded_space(t).alias("folded"), T.tokens_estimate(t).alias("n_tokens"),
        F.octet_length(t).cast("long").alias("n_bytes"), F.size(T.compounds(t)).alias("n_compounds"), F.size(T.content_words(t)).alias("n_content"),
    )


def stems(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


def stemmed_tokens(spark, d):
    """Stems of each document, compounds whole and in parts, without stop words, counted."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.stemmed(F.col("text"))).alias("stem"))
    return rows.groupBy("doc_id", "stem").agg(F.count("*").alias("n"))


DOUBLE = "|".join(c + c for c in "bcdfghjkmnpqrtv")
#: of a word w of more than three letters: plural, then ing or ed (a doubled consonant made single), then a last e
STEM = f"""p AS (SELECT w, CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END AS a FROM w WHERE length(w) > 3),
  c AS (SELECT w, CASE WHEN length(a) > 5 AND a LIKE '%ing' THEN left(a, length(a) - 3) WHEN length(a) > 4 AND a LIKE '%ed' THEN left(a, length(a) - 2) ELSE a END AS b, a FROM p),
  d AS (SELECT w, CASE WHEN a != b AND length(b) > 3 AND regexp_matches(b, '({DOUBLE})$') THEN left(b, length(b) - 1) ELSE b END AS c FROM c),
  st AS (SELECT w, CASE WHEN length(c) > 4 AND c LIKE '%e' THEN left(c, length(c) - 1) ELSE c END AS stem FROM d UNION ALL SELECT w, w FROM w WHERE length(w) <= 3)"""

QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, tfidf_topk, rrf_fusion, weighted_fusion, interleave, bridge_terms, prf_expand, containment, recall_mrr, mean_metrics, head_to_head,
        sweep_alpha, query_work, term_stats, text_measures, stems, stemmed_tokens,
    )
}

FUSED = """wf AS (SELECT query_id, doc_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM
  (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS a FROM bm WINDOW w AS (PARTITION BY query_id))
  FULL JOIN (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS b FROM tm WINDOW w AS (PARTITION BY query_id)) USING (query_id, doc_id))"""
BRIDGE = """br AS MATERIALIZED (SELECT * FROM (SELECT query_id, term, weight, CAST(row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS INT) AS place FROM
  (SELECT query_id, term, round(tf * (ln((1 + n) / (1 + df)) + 1), 6) AS weight FROM p JOIN df USING (term) JOIN (SELECT query_id, doc_id FROM bm WHERE rank = 1) USING (doc_id), tot)
  ANTI JOIN q USING (query_id, term)) WHERE place <= 3)"""
ORACLES = {
    "bm25_topk": f"WITH {BASE}, {BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10",
    "tfidf_topk": f"WITH {BASE}, {TFIDF} SELECT query_id, doc_id, score, rank FROM tm WHERE rank <= 10",
    "rrf_fusion": f"""WITH {BASE}, {BM25}, {TFIDF}, u AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM
      (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM tm) GROUP BY ALL)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM u) WHERE rank <= 10""",
    "weighted_fusion": f"""WITH {BASE}, {BM25}, {TFIDF}, {FUSED}, s AS (SELECT query_id, doc_id, round(0.5::DOUBLE * a + 0.5::DOUBLE * b, 6) AS score FROM wf)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s) WHERE rank <= 10""",
    "interleave": f"""WITH {BASE}, {BM25}, {TFIDF}, u AS (SELECT query_id, doc_id, min(place) AS place FROM
      (SELECT query_id, doc_id, 2 * rank - 1 AS place FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 2 * rank FROM tm WHERE rank <= 10) GROUP BY ALL)
      SELECT * FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INT) AS rank FROM u) WHERE rank <= 10""",
    "bridge_terms": f"WITH {BASE}, {BM25}, {BRIDGE} SELECT query_id, term, weight, place FROM br",
    "prf_expand": f"""WITH {BASE}, {BM25}, {BRIDGE}, q2 AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, term FROM q UNION ALL SELECT query_id, term FROM br)),
      s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM p JOIN q2 USING (term) JOIN df USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "containment": f"WITH {SHINGLES} SELECT query_id, doc_id, share FROM con",
    "recall_mrr": f"WITH {BASE}, {BM25}, {SHINGLES} SELECT * FROM {metric_sql('bm')}",
    "mean_metrics": f"WITH {BASE}, {BM25}, {TFIDF}, {SHINGLES} SELECT 'bm25' AS system, round(avg(recall), 5) AS recall, round(avg(rr), 5) AS mrr FROM {metric_sql('bm')} UNION ALL SELECT 'tfidf', round(avg(recall), 5), round(avg(rr), 5) FROM {metric_sql('tm')}",
    "head_to_head": f"""WITH {BASE}, {BM25}, {TFIDF}, {SHINGLES} SELECT count(*) FILTER (a.rr > b.rr) AS wins, count(*) FILTER (a.rr < b.rr) AS losses, count(*) FILTER (a.rr = b.rr) AS ties
      FROM {metric_sql('bm')} a JOIN {metric_sql('tm')} b USING (query_id)""",
    "sweep_alpha": f"""WITH {BASE}, {BM25}, {TFIDF}, {FUSED}, {SHINGLES}, al AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS alpha),
      s AS (SELECT alpha, query_id, doc_id, round(alpha * a + (1 - alpha) * b, 6) AS score FROM wf, al),
      r AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, doc_id) AS rank FROM s),
      f AS (SELECT alpha, query_id, min(rank) AS first FROM r JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY ALL)
      SELECT alpha, round(avg(round(coalesce(1 / first, 0), 6)), 5) AS mrr FROM (SELECT DISTINCT query_id, alpha FROM rel, al) LEFT JOIN f USING (alpha, query_id) GROUP BY alpha""",
    "query_work": f"""WITH {BASE}, h AS (SELECT query_id, term, doc_id FROM p JOIN q USING (term)),
      b AS (SELECT query_id, sum(c) AS touched, max(c) AS head FROM (SELECT query_id, term, count(*) AS c FROM h GROUP BY ALL) GROUP BY query_id)
      SELECT query_id, CAST(touched AS BIGINT) AS touched, candidates, round(head / touched, 6) AS head_share FROM b JOIN (SELECT query_id, count(DISTINCT doc_id) AS candidates FROM h GROUP BY query_id) USING (query_id)""",
    "term_stats": f"WITH {BASE} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term",
    "text_measures": r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS n_words, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS squashed,
      trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '\s+', ' ', 'g')) AS folded, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS n_tokens, CAST(strlen(text) AS BIGINT) AS n_bytes,
      CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[-_][\p{L}\p{N}]+)*')) AS INT) AS n_compounds,
      CAST(len(list_filter(regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\p{L}\p{N}]+'), lambda w: w NOT IN (""" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + r"""))) AS INT) AS n_content FROM documents""",
    "stems": f"""WITH w AS (SELECT DISTINCT unnest({D}) AS w FROM documents), {STEM} SELECT w AS word, stem FROM st""",
    "stemmed_tokens": rf"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[-_][a-z0-9]+)*')) AS r FROM documents),
      t AS (SELECT doc_id, r AS w FROM r UNION ALL SELECT doc_id, unnest(regexp_split_to_array(r, '[-_]')) FROM r WHERE regexp_matches(r, '[-_]')),
      k AS (SELECT doc_id, w FROM t WHERE w NOT IN ({", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS)})), w AS (SELECT DISTINCT w FROM k), {STEM}
      SELECT doc_id, stem, count(*) AS n FROM k JOIN st USING (w) GROUP BY ALL""",
}
