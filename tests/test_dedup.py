"""Pairs of similar sets against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from millrace.operators import dedup
from millrace.plans import analysis


def sets(seed=5):
    """Groups of sets with a few members changed; equal sets and unlike ones among them."""
    r = random.Random(seed)
    out = []
    for _ in range(25):
        one = r.sample(range(1 << 59), r.randint(1, 60))
        for _ in range(r.randint(1, 6)):
            out.append({x if r.random() > r.choice((0, 0.04, 0.1)) else r.randrange(1 << 59) for x in one})
    r.shuffle(out)
    return out


def frame(spark, found):
    return spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(found) if x], "doc_id long, s array<long>")


def similar(found, least=0.8):
    return {(a, b) for (a, x), (b, y) in combinations(enumerate(found), 2) if round(len(x & y) / len(x | y), 6) >= least}


def test_every_pair_of_a_bucket_is_a_candidate(spark):
    rows = frame(spark, sets())
    m = dedup.minhash(rows).collect()
    band = lambda r, b: tuple(r[f"h{i}"] for i in range(4 * b, 4 * b + 4))
    want = {(x.doc_id, y.doc_id) for x in m for y in m if x.doc_id < y.doc_id and any(band(x, b) == band(y, b) for b in range(4))}
    assert {tuple(r) for r in dedup.candidates(dedup.minhash(rows)).collect()} == want


def test_similar_pairs_are_exact(spark):
    found = sets()
    got = dedup.similar_pairs(frame(spark, found)).collect()
    assert {(r.a, r.b) for r in got} == similar(found) and len(got) == len(similar(found)) > 50


def test_queries_give_every_pair_and_count_missed_ones(spark, monkeypatch):
    found = sets()
    rows, truth = frame(spark, found), similar(found)
    monkeypatch.setattr(analysis, "rows_of", lambda spark, d: rows)
    assert {(r.a, r.b) for r in analysis.minhash_lsh_pairs(spark, "").collect()} == truth
    said = {tuple(r) for r in dedup.candidates(dedup.minhash(rows)).collect()}
    got = analysis.lsh_pair_scores(spark, "").first()
    assert (got.tp, got.fp, got.fn) == (len(said & truth), len(said - truth), len(truth - said)) and got.fn > 0


def test_simhash_equals_votes_and_takes_rows_of_a_document_as_one_set(spark):
    found = sets(7)
    rows = [(i, sorted(x)) for i, x in enumerate(found) if x] + [(0, sorted(found[0])), (1, [5, 9]), (None, [3]), (10**6, [])]
    want = {}
    for i, x in rows:
        want.setdefault(i, set()).update(x)
    votes = {i: sum(1 << k for k in range(60) if 2 * sum(v >> k & 1 for v in x) > len(x)) for i, x in want.items()}
    got = dedup.simhash(spark.createDataFrame(rows, "doc_id long, s array<long>")).collect()
    assert {r.doc_id: r.simhash for r in got} == votes and len(got) == len(votes)


def test_scores_are_counted_without_writing_pairs_down(spark, monkeypatch):
    """Copies by the thousand, near copies of them, and a document in two rows: the counts of all pairs."""
    r = random.Random(3)
    one = r.sample(range(1 << 59), 40)
    found = sets(9) + [set(one) for _ in range(40)] + [set(one[:36]) for _ in range(30)] + [set(one[:36]) | {k} for k in range(5)]
    rows = [(i, sorted(x)) for i, x in enumerate(found) if x]
    frame_ = spark.createDataFrame([(rows[0][0], rows[0][1][:1]), *rows, (None, [5])], "doc_id long, s array<long>")
    truth = similar(found)
    said = {tuple(x) for x in dedup.candidates(dedup.minhash(spark.createDataFrame(rows, "doc_id long, s array<long>"))).collect()}
    monkeypatch.setattr(dedup, "candidates", None)
    got = dedup.candidate_scores(frame_).first()
    assert (got.tp, got.fp, got.fn) == (len(said & truth), len(said - truth), len(truth - said)) and got.tp > 2000 and got.fp > 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.array(*map(F.lit, one)).alias("s"))
    assert tuple(dedup.candidate_scores(many).first()) == (199_990_000, 0, 0, 1.0, 1.0, 1.0)
