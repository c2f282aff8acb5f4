"""Queries on extraction scores, grounding, features, generators, quantised grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import evaluation as E
from millrace.operators import extraction as X
from millrace.operators import features as B
from millrace.operators import grounding as H
from millrace.operators import vectors as V
from millrace.plans.analysis import EM, KNN, SCORED, W, scored, vectors
from millrace.sources import generators as N
from millrace.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# extraction --------------------------------------------------------------------------------------------------

LEAVES = """g AS MATERIALIZED (SELECT o_orderkey AS id, unnest(['total', 'date', 'status', 'priority']) AS path, unnest([CAST(round(o_totalprice, 2) AS VARCHAR), '"' || strftime(o_orderdate, '%Y-%m-%d') || '"', '"' || o_orderstatus || '"', '"' || o_orderpriority || '"']) AS value FROM orders),
  s AS MATERIALIZED (SELECT id, path, CASE WHEN path = 'date' AND id % 5 = 0 THEN '"' || strftime(CAST(value[2:-2] AS DATE), '%b %-d, %Y') || '"' WHEN path = 'priority' AND id % 4 = 0 THEN lower(value) WHEN path = 'status' AND id % 11 = 0 THEN '"X"' ELSE value END AS value FROM g WHERE NOT (path = 'total' AND id % 7 = 0))"""
MATCH = """m AS (SELECT id, path, CASE WHEN s.value IS NULL THEN 'missing' WHEN g.value = s.value OR (path = 'date' AND id % 5 = 0) OR (path = 'priority' AND id % 4 = 0) THEN 'correct' ELSE 'wrong' END AS kind FROM g LEFT JOIN s USING (id, path)),
  t AS (SELECT path, count(*) FILTER (kind = 'correct') AS correct, count(*) FILTER (kind = 'wrong') AS wrong, count(*) FILTER (kind = 'missing') AS missing, 0::BIGINT AS spurious FROM m GROUP BY 1)"""


def leaves(spark, d):
    """Orders as leaf tables: gold, and an extraction with other formats, errors and gaps."""
    o = table(spark, d, "orders")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    cells = F.array(
        *[F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in {
            "total": F.round("o_totalprice", 2).cast("decimal(18,2)").cast("double").cast("string"), "date": text(F.date_format("o_orderdate", "yyyy-MM-dd")),
            "status": text(F.col("o_orderstatus")), "priority": text(F.col("o_orderpriority")),
        }.items()]
    )
    gold = o.select(F.col("o_orderkey").alias("id"), F.explode(cells).alias("c")).select("id", "c.path", "c.value")
    id_, path, value = F.col("id"), F.col("path"), F.col("value")
    other = F.when((path == "date") & (id_ % 5 == 0), text(F.date_format(F.substring(value, 2, 10).cast("date"), "MMM d, yyyy")))
    other = other.when((path == "priority") & (id_ % 4 == 0), F.lower(value)).when((path == "status") & (id_ % 11 == 0), '"X"').otherwise(value)
    return gold, gold.where(~((path == "total") & (id_ % 7 == 0))).withColumn("value", other)


@query(f"WITH {LEAVES}, {MATCH} SELECT * FROM t")
def leaf_tallies(spark, d):
    return X.tallied(*leaves(spark, d))


@query(f"WITH {LEAVES}, {MATCH}, f AS (SELECT correct / (correct + wrong + spurious) AS p, correct / (correct + wrong + missing) AS r FROM t) SELECT round(avg(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)), 5) AS macro_f1, count(*) AS paths FROM f")
def macro_f1(spark, d):
    return X.macro(X.tallied(*leaves(spark, d)))


@query(f"WITH {LEAVES}, {MATCH}, u AS (SELECT path, correct * 2 AS correct, wrong * 2 AS wrong, missing * 2 AS missing, spurious FROM t) SELECT path, correct, wrong, missing, spurious FROM u")
def merged_tallies(spark, d):
    t = X.tallied(*leaves(spark, d))
    return X.merged(t, t)


@query(f"WITH {LEAVES}, e AS (SELECT id, bool_and(coalesce(g.value = s.value, false)) AS same FROM g LEFT JOIN s USING (id, path) GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (same) AS exact, round(count(*) FILTER (same) / count(*), 6) AS rate FROM e")
def exact_match_rate(spark, d):
    return X.exact_rate(*leaves(spark, d))


@query(f"WITH {LEAVES} SELECT id, count(*) AS leaves FROM s GROUP BY 1")
def leaf_counts(spark, d):
    return X.leaf_counts(leaves(spark, d)[1])


DRAW = "CAST('0x' || left(md5('3-' || id || '-' || path), 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"WITH {LEAVES} SELECT id, path, value FROM g WHERE {DRAW} >= 0.2")
def dropped_leaves(spark, d):
    return X.dropped_leaves(leaves(spark, d)[0], 0.2, 3)


@query(f"""WITH {LEAVES} SELECT id, path, CASE WHEN {DRAW} < 0.2 THEN '"' || value[2:-2] || '~"' ELSE value END AS value FROM g WHERE path != 'total'""")
def corrupted_leaves(spark, d):
    return X.corrupted_leaves(leaves(spark, d)[0].where("path != 'total'"), 0.2, 3)


def items(spark, d):
    """Line items of each order as array elements, and the same in another order with every ninth quantity wrong."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("element"), F.array(
        F.struct(F.lit("part").alias("path"), F.col("l_partkey").cast("string").alias("value")), F.struct(F.lit("quantity").alias("path"), F.col("l_quantity").cast("int").cast("string").alias("value")),
    ).alias("c"))
    gold = li.select("id", "element", F.explode("c").alias("c")).select("id", "element", "c.path", "c.value")
    wrong = F.when((F.col("path") == "quantity") & ((F.col("id") + F.col("element")) % 9 == 0), "-1").otherwise(F.col("value"))
    return gold, gold.select("id", (100 - F.col("element")).alias("element"), "path", wrong.alias("value"))


@query(None)  # a greedy matching; held against a brute-force version
def aligned_arrays(spark, d):
    return X.aligned(X.element_scores(*items(spark, d)))


@query("""WITH g AS (SELECT l_orderkey AS id, l_linenumber AS e, unnest(['part', 'quantity']) AS path, unnest([CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR)]) AS value FROM lineitem),
  s AS (SELECT id, 100 - e AS e, path, CASE WHEN path = 'quantity' AND (id + e) % 9 = 0 THEN '-1' ELSE value END AS value FROM g),
  n AS (SELECT id, e, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT id, e, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT g.id, g.e AS gi, s.e AS pi, count(*) AS c FROM g JOIN s USING (id, path, value) GROUP BY ALL)
  SELECT c.id, CAST(gi AS BIGINT) AS gi, CAST(pi AS BIGINT) AS pi, round(2 * c / (n.n + m.n), 9) AS f1 FROM c JOIN n ON n.id = c.id AND n.e = gi JOIN m ON m.id = c.id AND m.e = pi""")
def element_scores(spark, d):
    return X.element_scores(*items(spark, d))


# grounding ---------------------------------------------------------------------------------------------------


@query(None)  # sentences are cut by rules that SQL lacks; held against pinned cases
def grounded_claims(spark, d):
    """Each benchmark passage as a claim on the document of its number."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("claim"))
    return H.grounded(b.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("context")), "id"))


@query(None)
def scored_answers(spark, d):
    """The best sentence for each benchmark passage among its three best documents."""
    from millrace.operators import retrieval as R
    from millrace.plans.retrieval import corpus

    docs, q = corpus(spark, d)
    top = R.bm25(docs, q, 3).join(docs, "doc_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    return H.answered(q.join(top, "query_id").select(F.col("query_id").alias("id"), F.col("text").alias("question"), "texts"))


@query(None)
def assembled_contexts(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return H.assembled_contexts(t)


# features ----------------------------------------------------------------------------------------------------

FNV = "list_reduce(list_prepend(2166136261, [CAST(unicode(c) AS BIGINT) for c in string_split({0}, '') if c != '']), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"SELECT conv_id, turn, {FNV.format('role')} AS h FROM conversations")
def role_hashes(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.fnv1a(F.col("role")).alias("h"))


GRAMS = f"""w AS (SELECT conv_id * 1000000 + turn AS id, {W} AS w FROM conversations),
  g AS (SELECT id, unnest(['w:' || x for x in w] || [('b:' || w[i] || ' ' || w[i + 1]) for i in generate_series(1, len(w) - 1)]) AS g FROM w),
  b AS (SELECT g, {FNV.format('g')} & 1048575 AS bucket FROM (SELECT DISTINCT g FROM g)), n AS (SELECT id, bucket, count(*) AS n FROM g JOIN b USING (g) GROUP BY ALL),
  v AS MATERIALIZED (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM n)"""


def turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), "conv_id", "turn", "text")


@query(f"WITH {GRAMS} SELECT id, bucket, round(w, 6) AS w FROM v")
def word_vectors(spark, d):
    return B.vectors(turns(spark, d), "id").select("id", "bucket", F.round("w", 6).alias("w"))


@query(f"""WITH {GRAMS}, p AS (SELECT conv_id * 1000000 + turn AS a, conv_id * 1000000 + turn + 2 AS b FROM conversations SEMI JOIN (SELECT conv_id, turn - 2 AS turn FROM conversations) USING (conv_id, turn)),
  c AS (SELECT p.a, p.b, sum(x.w * y.w) AS dot FROM p JOIN v x ON x.id = p.a JOIN v y ON y.id = p.b AND x.bucket = y.bucket GROUP BY ALL) SELECT a, b, round(coalesce(dot, 0), 6) AS cosine FROM p LEFT JOIN c USING (a, b)""")
def turn_similarities(spark, d):
    """Cosines of turns two apart."""
    t = turns(spark, d)
    pairs = t.select("conv_id", "turn").join(t.select("conv_id", (F.col("turn") - 2).alias("turn")), ["conv_id", "turn"], "left_semi").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("a"))
    v = B.vectors(t, "id")
    return B.cosines(pairs.withColumn("b", F.col("a") + 2), v, v, "id")


WORDS = r"w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\S+')) AS word FROM documents) GROUP BY 1), v AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) AS INT) AS id FROM w QUALIFY id < 1000)"


@query(f"WITH {WORDS} SELECT * FROM v")
def word_vocabulary(spark, d):
    return B.word_vocabulary(table(spark, d, "documents"), 1000)


@query(f"WITH {WORDS} SELECT CAST(sum(n) AS BIGINT) AS words, CAST(sum(n) FILTER (v.word IS NULL) AS BIGINT) AS unknown, round(sum(n) FILTER (v.word IS NULL) / sum(n), 6) AS rate FROM w LEFT JOIN v USING (word)")
def unknown_words(spark, d):
    docs = table(spark, d, "documents")
    return B.unknown_words(docs, B.word_vocabulary(docs, 1000))


@query("SELECT DISTINCT c FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c != '' AND c NOT IN (SELECT DISTINCT unnest(string_split(text, '')) FROM benchmark)")
def unseen_characters(spark, d):
    return B.unseen_characters(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query(f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT unnest({W}) AS term FROM benchmark)")
def vocabulary(spark, d):
    return B.vocabulary(table(spark, d, "benchmark"))


@query(f"WITH v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT unnest({W}) AS term FROM benchmark)) SELECT doc_id, id, count(*) AS n FROM (SELECT doc_id, unnest({W}) AS term FROM documents) JOIN v USING (term) GROUP BY ALL")
def term_counts(spark, d):
    return B.vectorized(table(spark, d, "documents"), B.vocabulary(table(spark, d, "benchmark")))


@query(None)  # a fold over requests
def cache_replay(spark, d):
    rows = N.traffic(spark, table(spark, d, "events").count() // 10, seed=3)
    return B.replay_totals(B.replayed(rows.withColumn("part", F.col("intent") % 8), 0.8, 0.02))


# generators --------------------------------------------------------------------------------------------------

U = "CAST('0x' || left(md5({0}), 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"SELECT vec_id, array_to_string([CAST(floor({U.format(repr('5-') + ' || vec_id || ' + repr('-') + ' || k')} * 1000) AS INT) for k in generate_series(1, 8)], ',') AS v FROM embeddings")
def generated_vectors(spark, d):
    v = N.uniform_vectors(spark, 100_000, 8, 5).join(table(spark, d, "embeddings").select("vec_id"), "vec_id")
    return v.select("vec_id", F.array_join(F.transform("embedding", lambda x: F.floor(x * 1000).cast("int")), ",").alias("v"))


@query(f"""WITH r AS (SELECT id, least(50, CAST(floor(pow({U.format("'9-' || id || '-intent'")} * (pow(51.0::DOUBLE, 1 - 1.1::DOUBLE) - 1) + 1, 1 / (1 - 1.1::DOUBLE))) AS INT)) AS intent FROM generate_series(0, 4999) t(id)) SELECT intent, count(*) AS n FROM r GROUP BY 1""")
def generated_intents(spark, d):
    return N.traffic(spark, 5000, 50, 9).groupBy("intent").agg(F.count("*").alias("n"))


@query(f"SELECT round(sum(-ln(1 - {U.format(repr('4-') + ' || id || ' + repr('-gap'))}) * 50), 3) AS total, round(max(-ln(1 - {U.format(repr('4-') + ' || id || ' + repr('-gap'))}) * 50), 3) AS longest FROM generate_series(0, 1999) t(id)")
def generated_arrivals(spark, d):
    return N.arrivals(spark, 2000, 50.0, 4).agg(F.round(F.max("at_ms"), 3).alias("total"), F.round(F.max("gap_ms"), 3).alias("longest"))


# quantised grids ---------------------------------------------------------------------------------------------


def grid_recall(vectors_, queries, truth, levels, clip):
    fitted = V.grid(vectors_, levels, clip)
    near = V.exact_knn(V.grid_decoded(V.grid_codes(vectors_, levels, fitted), fitted), queries)
    return V.recall(near, truth).agg(F.round(F.avg("recall"), 5).alias("recall"))


def clipped(lo: str, hi: str) -> str:
    return f"""cell AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e), g AS (SELECT dim, {lo} AS lo, ({hi} - {lo}) / 15 AS step FROM cell GROUP BY dim),
  w AS (SELECT vec_id, list(lo + greatest(0, least(15, CASE WHEN step > 0 THEN round_even((x - lo) / step, 0) ELSE 0 END)) * step ORDER BY dim) AS w FROM cell JOIN g USING (dim) GROUP BY vec_id),
  c2 AS (SELECT q.vec_id AS query_id, b.vec_id, round(list_sum([(q.v[i] - b.w[i]) ** 2 for i in generate_series(1, len(q.v))]), 5) AS distance FROM e q, w b WHERE q.vec_id % 20 = 0),
  k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM c2),
  r AS (SELECT query_id, round(avg((k2.vec_id IS NOT NULL)::INT), 6) AS recall FROM (SELECT * FROM k WHERE rank <= 10) k LEFT JOIN (SELECT query_id, vec_id FROM k2 WHERE rank <= 10) k2 USING (query_id, vec_id) GROUP BY query_id)"""


@query(f"WITH {KNN}, {clipped('min(x)', 'max(x)')} SELECT round(avg(recall), 5) AS recall FROM r")
def grid_recall_whole(spark, d):
    e, q = vectors(spark, d)
    return grid_recall(e, q, V.exact_knn(e, q), 16, 0.0)


@query(f"WITH {KNN}, {clipped('quantile_cont(x, 0.01)', 'quantile_cont(x, 0.99)')} SELECT round(avg(recall), 5) AS recall FROM r")
def grid_recall_clipped(spark, d):
    e, q = vectors(spark, d)
    return grid_recall(e, q, V.exact_knn(e, q), 16, 0.01)


@query("SELECT s AS scheme, CAST(CASE s WHEN 'float32' THEN 4 * n * d WHEN 'int8' THEN n * d + 4 * n WHEN 'grid8' THEN n * d + 8 * d ELSE n * ((d + 1) // 2) + 8 * d END AS BIGINT) AS bytes FROM (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings), (SELECT unnest(['float32', 'int8', 'grid8', 'grid4']) AS s)")
def store_bytes(spark, d):
    n, dim = table(spark, d, "embeddings").agg(F.count("*"), F.max(F.size("embedding"))).first()
    return spark.createDataFrame([(s, V.total_bytes(s, n, dim)) for s in ("float32", "int8", "grid8", "grid4")], "scheme string, bytes long")


@query(f"WITH {EM}, {SCORED} SELECT round(avg(abs(score - good::INT)), 6) AS mean_error, round(max(abs(score - good::INT)), 6) AS max_error FROM l")
def absolute_errors(spark, d):
    return E.absolute_errors(scored(spark, d).withColumn("truth", F.col("good").cast("int")), "score", "truth")
