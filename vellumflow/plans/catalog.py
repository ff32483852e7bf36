"""All registered queries of the core engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumflow.plans import change_queries, decision_queries, intervention_queries, layout_queries, relation_queries, search_queries, text_queries  # noqa: F401  (they register their queries)
from vellumflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["f11_field_search"](spark, sf_dir)
