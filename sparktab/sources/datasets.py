"""Materialised data sets and their metadata (SNK-02..05).

A data set is a parquet folder in the shared checkpoint folder plus one
metadata row.  The row count comes from the footers of the written files,
the size from the file listing.  A replacement writes a new version
folder and switches the metadata; the folder being read is never
overwritten."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.session import checkpoint_path

META_SCHEMA = ("name string, path string, version int, row_count long, column_count int, file_size_mb double, "
               "created_at timestamp, generation_type string")


def _size_mb(spark: SparkSession, path: str) -> float:
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    total = listing.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]  # one scalar
    return round(total / (1024 * 1024), 6)


def materialise(spark: SparkSession, df: DataFrame, name: str, version: int = 1,
                generation_type: str | None = None) -> DataFrame:
    """SNK-02: write ``df`` as a named data set; return its metadata row."""
    path = checkpoint_path(spark, f"dataset-{name}-v{version}")
    df.write.mode("overwrite").parquet(path)
    # row count from the parquet footers of the written files (no data scan).
    # DataFrame.observe is avoided on purpose: it attaches a non-serializable
    # observation manager to the session, which then breaks the shipping of
    # fitted models that keep a reference to the session (training summaries).
    rows = spark.read.parquet(path).count()
    meta = [(name, path, version, int(rows), len(df.columns), _size_mb(spark, path),
             _dt.datetime.now(), generation_type)]
    return spark.createDataFrame(meta, META_SCHEMA)


def replace(spark: SparkSession, meta: DataFrame, new_df: DataFrame) -> DataFrame:
    """SNK-05 / CLN-14 store step: write the new rows as the next version and
    return the switched metadata row."""
    m = meta.first()  # one metadata row
    return materialise(spark, new_df, m["name"], m["version"] + 1, m["generation_type"])


def listing(meta: DataFrame, n: int | None = None) -> DataFrame:
    """SNK-03: newest first; a missing generation type reads 'manual'."""
    out = meta.withColumn("generation_type", F.coalesce("generation_type", F.lit("manual"))) \
              .orderBy(F.desc("created_at"), F.desc("id"))
    return out.limit(n) if n else out


def preview(df: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """SNK-04: the first ``limit`` rows by key (<= 0: all), NaN as null, with total_rows."""
    from sparktab.operators.sequence import one_row
    total = one_row(df.agg(F.count(F.lit(1)).alias("total_rows")))["total_rows"]
    cols = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name) for f in df.schema.fields]
    rows = df.select(*cols)
    rows = rows.orderBy(key).limit(limit) if limit > 0 else rows
    return rows.withColumn("total_rows", total)
