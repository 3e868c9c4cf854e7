"""Parquet scans of the given tables and of silver/gold outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read one parquet table.  Projection and filters applied later reach the
    scan (ReadSchema / PushedFilters), so callers select only what they use."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def read_silver(spark: SparkSession, silver_dir: str, tables: list[str]) -> dict[str, DataFrame]:
    """Read the five silver tables written by the CDC stage."""
    return {t: spark.read.parquet(f"{silver_dir.rstrip('/')}/{t}") for t in tables}
