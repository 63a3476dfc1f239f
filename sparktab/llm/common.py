"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktab.session import checkpoint_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder named by ``spark.checkpoint.dir``
    and read it back: cuts the lineage, survives lost executors, and later
    reads see one and the same set of rows."""
    path = checkpoint_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 3, is 1 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def text_key(text: str = "text") -> Column:
    """Identifies a text beside its id, so that rows with one id and different
    texts stay apart; a null text has a key of its own."""
    return F.coalesce(F.xxhash64(F.lit(1), F.col(text)), F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows (text, y) that are not held out, chosen
    by a hash of the id; rows without an id, a label or a text don't train,
    and an id with several labels counts once, with the larger one."""
    y = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
         .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    pick = y.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(limit)
    d = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    # at most `limit` rows of an id and a bit: bounded, so it may be broadcast
    return d.join(F.broadcast(pick), "doc_id").select("doc_id", "text", "y")


def running(df: DataFrame, order: list[str], values: dict[str, str], name: str) -> DataFrame:
    """``df`` with, for each ``values`` (new column -> column), the sum over all
    rows before it by ``order`` (unique, nulls first): range shuffle, sums
    inside a task, and the totals of the tasks before (one row a task,
    broadcast).  Written once, since a second range shuffle may cut elsewhere."""
    w = Window.partitionBy("_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_task", F.spark_partition_id())
    local = save(dealt.withColumns({f"_{new}": F.coalesce(F.sum(c).over(w), F.lit(0)) for new, c in values.items()}), name)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("_task").agg(*[F.sum(c).alias(f"_all_{new}") for new, c in values.items()])
    totals = totals.select("_task", *[F.coalesce(F.sum(f"_all_{new}").over(before), F.lit(0)).alias(f"_off_{new}") for new in values])
    return local.join(F.broadcast(totals), "_task").withColumns({new: F.col(f"_{new}") + F.col(f"_off_{new}") for new in values}) \
        .drop("_task", *[f"_{new}" for new in values], *[f"_off_{new}" for new in values])


def frame(**columns):
    """A pandas frame for Arrow, name=(values, type): an empty one keeps its types."""
    import pandas as pd
    return pd.DataFrame({c: pd.Series(list(v), dtype=t) for c, (v, t) in columns.items()})


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def trim() -> None:
    """Gives freed memory of a Python worker back: its next task may need it elsewhere."""
    import ctypes
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
