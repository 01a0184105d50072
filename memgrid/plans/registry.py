"""All queries of the library by name, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memgrid.plans import catalog
from memgrid.plans import q_engines, q_events, q_graph, q_nodes, q_retrieval, q_text, q_vectors, q_lifecycle, q_evaluation, q_streams  # noqa: F401  they register themselves
from memgrid.sources.logical import Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_retrieval.hybrid_search(Tables(spark, sf_dir))


def _bound(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(f) for name, f in catalog.QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(catalog.SQL)
