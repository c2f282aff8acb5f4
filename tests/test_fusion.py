"""Fusions rank all documents that a ranking has; only the result is cut."""

import pytest

from millrace.operators import retrieval
from millrace.plans import retrieval as plans


@pytest.fixture
def planted(spark, monkeypatch):
    """Document 60 is at rank 60 of both rankings of 1,000; they have no other document in common."""

    def given(far):
        rows = [(1, 60 if i == 60 else far + i, float(1000 - i), i) for i in range(1, 1001)]
        ranking = spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")
        return lambda docs, items, k=10: ranking if k is None else ranking.where(f"rank <= {k}")

    monkeypatch.setattr(plans, "corpus", lambda spark, d: (None, None))
    monkeypatch.setattr(plans, "relevant", lambda docs, items: spark.createDataFrame([(1, 60)], "query_id long, doc_id long"))
    monkeypatch.setattr(retrieval, "bm25", given(10_000))
    monkeypatch.setattr(retrieval, "tfidf", given(20_000))


def test_rrf_fuses_low_places(spark, planted):
    got = plans.rrf_fusion(spark, "").collect()
    assert len(got) == 10
    assert [(r.doc_id, r.score) for r in got if r["rank"] == 1] == [(60, round(2 / 120, 9))]  # 1 / 61 is less


def test_weighted_fusion_scales_over_all(spark, planted):
    got = plans.weighted_fusion(spark, "").collect()
    assert [(r.doc_id, r.score) for r in got if r["rank"] <= 2] == [(60, round(940 / 999, 6)), (10_001, 0.5)] and len(got) == 10


def test_sweep_finds_low_places(spark, planted):
    assert {r.alpha: r.mrr for r in plans.sweep_alpha(spark, "").collect()} == {0.0: 0.0, 0.25: 1.0, 0.5: 1.0, 0.75: 1.0, 1.0: 0.0}
