"""Table access and simple sinks (SNK-01 CSV, parquet tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (`{base_dir}/{name}.parquet`)."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-01: CSV with a header line and no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
