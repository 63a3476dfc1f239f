"""Chart-ready aggregates (VIZ-*); the drawing itself is not built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktab.operators.sequence import one_row


def histogram(df: DataFrame, value: str, group: list[str] | None = None, bins: int = 50) -> DataFrame:
    """VIZ-01: equal-width histogram per group over the group's own range; the
    maximum falls in the last bin; a constant group goes to the middle bin.
    The ranges, a row a group of a chart, go to every task: a few groups, one of
    which may hold nearly all rows, are no key to deal the rows by."""
    group = group or []
    rng = df.groupBy(*group).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    if group:
        j = df.join(F.broadcast(rng), group)
    else:
        r = one_row(rng)
        j = df.withColumn("_mn", r["_mn"]).withColumn("_mx", r["_mx"])
    width = F.col("_mx") - F.col("_mn")
    b = F.when(width == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_mn")) / width * bins), F.lit(bins - 1)))
    g = j.where(F.col(value).isNotNull()).groupBy(*group, b.cast("int").alias("bin"), "_mn", "_mx") \
         .agg(F.count(F.lit(1)).alias("n"))
    return g.select(*group, "bin", "n",
                    (F.col("_mn") + (F.col("_mx") - F.col("_mn")) * F.col("bin") / bins).alias("bin_start"),
                    (F.col("_mn") + (F.col("_mx") - F.col("_mn")) * (F.col("bin") + 1) / bins).alias("bin_end"))


def top_rows(df: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    """VIZ-02: the n largest rows (ties by key), with the ascending display order."""
    top = df.orderBy(F.desc(value), F.asc(key)).limit(n)
    # n rows only: a global window over the top-n result is bounded
    return top.withColumn("display_order", F.row_number().over(Window.orderBy(F.asc(value), F.desc(key))))


def rate_by_group(df: DataFrame, group: str, flag: str, n: int = 10) -> DataFrame:
    """VIZ-03: count and mean flag (round 3) per group, the n largest groups."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(flag), 3).alias("rate"))
    return g.orderBy(F.desc("count"), F.asc(group)).limit(n)


def means_by_flag(df: DataFrame, flag: str, cols: list[str]) -> DataFrame:
    """VIZ-04: behaviour means per flag value, round 3."""
    return df.groupBy(flag).agg(*[F.round(F.avg(c), 3).alias(f"mean_{c}") for c in cols])


def residuals(scored: DataFrame, y: str, yhat: str, keys: list[str]) -> DataFrame:
    """VIZ-06: y - prediction per key (date)."""
    return scored.select(*keys, (F.col(y) - F.col(yhat)).alias("residual"))
