"""Driver parquet tables (read with explicit column projection so the scan prunes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as the passage table ``(doc_id, text)``."""
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
