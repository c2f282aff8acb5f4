"""All queries of the engine outside the pipeline subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import analysis, evaluation, policies, ranking, retrieval, stateful, studies, workload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (retrieval, analysis, stateful, workload, evaluation, ranking, studies, policies):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
