"""A training-corpus pipeline over ``documents``: every stage takes what its
predecessor kept, written as Parquet and read again.

quality       documents that the quality classifier rejects go
near_dedup    one document of each SimHash group stays, the one with the smallest id (a null id last)
decontaminate documents that hold a benchmark item go
secrets       reported secrets are replaced by a mark; all documents stay
pack          the rest is tokenised and packed into sequences of 4096 tokens

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm import decontam, packing, quality, queries, secret_scan, simhash
from sparktab.llm.common import save, table

#: Learning and tokenising are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores 0.5 or more; see ``quality.score`` for odd rows."""
    return docs.where(quality.score(docs, table(spark, sf_dir, "labels")) >= 0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash group, whatever ids its rows share or
    lack; see ``simhash.one_per_group`` for which."""
    return simhash.one_per_group(docs, words=3, bits=3)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents only; null and empty texts stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; secrets in its text become ``[SECRET]``."""
    return secret_scan.redact(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packing.pack_documents(docs, queries.tokenizer_path(), 4096)


STAGES = [("quality_classifier", quality_stage), ("simhash_near_dedup", near_dedup_stage), ("benchmark_decontamination", decontaminate_stage),
          ("secret_scan", secrets_stage), ("best_fit_packing", pack_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
