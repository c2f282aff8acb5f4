"""A corpus pipeline of five stages over `documents`; each works on all that the one before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontaminate, language, near_dedup, secrets
from millrace.llm.common import collected, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def afresh(stage: Stage) -> Stage:
    """stage, begun with executors that have given back the heap that stages before it took."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected(spark)
        return stage(spark, docs, sf_dir)

    return run


@afresh
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is uncertain, go."""
    return language.kept(docs)


@afresh
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document of least doc_id stays."""
    return near_dedup.deduplicated(docs, words=5)


@afresh
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold eight words in a row of two benchmark items or more go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@afresh
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays."""
    return secrets.redact(docs)


@afresh
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    return bpe.bpe_round_trip(docs)


STAGES = [
    ("language id", identify_language),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("bpe", encode),
]

ORACLE_SQL = None  # language ID and BPE can't be written in SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
