"""Exact quantiles by rank selection over range-partitioned value counts.

``percentile`` and ``median`` keep every distinct value of a column in one
buffer of one task.  Here equal values are counted first (combined before the
shuffle, so one hot value is one row a task), the counts are range-partitioned
by (column, value), and the partitions' totals tell which partition holds a
wanted rank.  Only those partitions, at most two for each quantile, are
sorted and summed up.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktab.operators.sequence import stable


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], parts: int | None = None) -> DataFrame:
    """One row: for each name in ``wanted`` (name -> (column, q)) the q-quantile
    of the column's non-null values as a double, interpolated linearly between
    the neighbouring ranks; null for a column without values."""
    spark = df.sparkSession
    columns = sorted({c for c, _ in wanted.values()})
    # long form, one row a value; a repeated column counts once
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")) \
        .select("x.c", "x.v").where("v is not null")
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    n_parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a second range exchange could cut elsewhere: written once
    ranged = stable(counts.repartitionByRange(n_parts, "c", "v").withColumn("p", F.spark_partition_id()))
    totals = ranged.groupBy("c", "p").agg(F.sum("n").alias("t"))
    size = {r["c"]: r["t"] for r in totals.groupBy("c").agg(F.sum("t").alias("t")).collect()}  # one row a column
    ranks: set[tuple[int, int]] = set()
    for c, q in wanted.values():
        i = columns.index(c)
        if size.get(i):
            at = (size[i] - 1) * q
            ranks |= {(i, floor(at)), (i, ceil(at))}
    if not ranks:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(name) for name in wanted])
    hit = lambda start, rows: reduce(lambda a, b: a | b, [(F.col("c") == c) & (start <= r) & (start + rows > r) for c, r in sorted(ranks)])
    before = F.coalesce(F.sum("t").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = totals.withColumn("b", before).where(hit(F.col("b"), F.col("t"))).select("c", "p", "b")  # at most one row a rank
    inside = Window.partitionBy("c", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    picked = ranged.join(F.broadcast(held), ["c", "p"]).withColumn("s", F.col("b") + F.coalesce(F.sum("n").over(inside), F.lit(0))) \
        .where(hit(F.col("s"), F.col("n")))
    out = []
    for name, (c, q) in wanted.items():
        i = columns.index(c)
        if not size.get(i):
            out.append(F.lit(None).cast("double").alias(name))
            continue
        at = (size[i] - 1) * q
        lo, hi = floor(at), ceil(at)
        value = lambda r, i=i: F.max(F.when((F.col("c") == i) & (F.col("s") <= r) & (F.col("s") + F.col("n") > r), F.col("v")))
        out.append((value(lo) if lo == hi else (hi - at) * value(lo) + (at - lo) * value(hi)).alias(name))
    return picked.agg(*out)
