"""All queries of the library with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varve.plans import aggregations, cluster_queries, file_queries, forest_queries, graph_queries, index_queries, knowledge, link_queries, question_queries, relational, resampling_queries, retrieval, soft_queries, state_queries, statistics_queries, stream_queries, sweep_queries  # noqa: F401
from varve.plans.base import ORACLES, QUERIES
from varve.sources.domain import Domain

__all__ = ["ORACLES", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).meta
