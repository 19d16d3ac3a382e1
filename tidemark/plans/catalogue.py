"""All queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import guards, metrics, series, texts, versions
from tidemark.plans.registry import ORACLE, QUERIES, Tables

__all__ = ["ORACLE", "QUERIES", "flagship", "guards", "metrics", "series", "texts", "versions"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.flagship_rows(Tables(spark, sf_dir))
