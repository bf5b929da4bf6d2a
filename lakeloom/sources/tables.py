"""The project's tables as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The names of the tables of the test data.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "lake_files", "data_file_partition_values", "deletion_file_map", "field_id_mappings", "iceberg_metadata",
    "raw_rows", "access_log", "benchmark", "mix_targets",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, sql: str) -> str:
    """Make a temporary view of each table that ``sql`` names; returns ``sql``."""
    words = set(re.findall(r"[a-z_]+", sql.lower()))
    for t in TABLES:
        if t in words:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return sql
