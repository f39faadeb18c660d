"""All queries of the library outside the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import model_queries, signal_queries

QUERIES: dict = signal_queries.QUERIES | model_queries.QUERIES
ORACLE_SQL: dict = signal_queries.ORACLE_SQL | model_queries.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diametrical clustering of the embeddings."""
    return model_queries.k2_diametrical(spark, sf_dir)
