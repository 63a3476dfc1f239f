"""Splits and samples (SPL-*), reproducible under repartitioning.

``randomSplit`` depends on the partitioning of its input; the default here is
a hash bucket of a key, which gives the same split on any cluster layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.operators.sequence import one_row, seq_number

HASH_RANGE = 1 << 32  # of ``key_hash``


def hash_bucket(key: Column, seed: int = 42, buckets: int = 100, method: str = "xxhash") -> Column:
    """Stable bucket of a key, see ``key_hash``."""
    return F.pmod(key_hash(key, seed, method), F.lit(buckets))


def key_hash(key: Column, seed: int = 42, method: str = "xxhash") -> Column:
    """A hash of the key below 2^32: xxhash64 (default), or the first eight hex
    digits of md5 of ``key:seed``, which other SQL engines compute alike.  A
    null key hashes like the empty text."""
    if method == "md5":
        text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(HASH_RANGE))


def random_split(df: DataFrame, key: str, ratios=(0.70, 0.15), seed: int = 42, out: str = "split",
                 method: str = "xxhash") -> DataFrame:
    """SPL-01: train / valid / test by hash bucket of the key (0.70 / 0.15 / rest)."""
    b = hash_bucket(F.col(key), seed, method=method)
    c1 = int(round(ratios[0] * 100))
    c2 = c1 + int(round(ratios[1] * 100)) if len(ratios) > 1 else 100
    lab = F.when(b < c1, F.lit("train")).when(b < c2, F.lit("valid")).otherwise(F.lit("test"))
    return df.withColumn(out, lab)


def temporal_split(df: DataFrame, order: str, part: list[str] | None = None, frac: float = 0.8,
                   out: str = "split", small_data_rows: int | None = None) -> DataFrame:
    """SPL-02: first floor(frac * n) rows by ``order`` are train, the rest test;
    SPL-04: with ``small_data_rows``, a series shorter than that is all train.

    A split over the whole frame numbers its rows over many tasks (``order``
    must be unique); with ``part`` a series is one window, so its grain should
    be days."""
    if not part:
        n = one_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
        lab = F.when(F.col("_rn") <= F.floor(n * frac), F.lit("train")).otherwise(F.lit("test"))
        lab = F.when(n < small_data_rows, F.lit("train")).otherwise(lab) if small_data_rows else lab
        return seq_number(df, [], [order], "_rn").withColumn(out, lab).drop("_rn")
    w = Window.partitionBy(*part).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    rn = F.row_number().over(w)
    lab = F.when(rn <= F.floor(n * frac), F.lit("train")).otherwise(F.lit("test"))
    if small_data_rows:
        lab = F.when(n < small_data_rows, F.lit("train")).otherwise(lab)
    return df.withColumn(out, lab)


def sample_fixed(df: DataFrame, key: str, n: int, seed: int = 42, method: str = "xxhash") -> DataFrame:
    """SPL-03: exactly n rows (all when fewer), chosen by the hash of the key.
    Sampling is the feature here, so the limit is part of the operator.  Rows
    are counted by hash slot (at most 65,536 counts) to find the slot that
    completes the sample; only rows up to it are sorted, so few more than n."""
    h = key_hash(F.col(key), seed, method)
    slot = F.floor(h / F.lit(HASH_RANGE >> 16))
    counts = df.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_upto", F.sum("_n").over(Window.orderBy("_slot")))
    last = one_row(counts.agg(F.coalesce(F.min(F.when(F.col("_upto") >= n, F.col("_slot"))), F.max("_slot")).alias("last")))["last"]
    return df.where(slot <= last).orderBy(h, F.col(key)).limit(n)


def kfold(df: DataFrame, key: str, k: int = 5, mode: str = "random", order: str | None = None,
          seed: int = 42, out: str = "fold", method: str = "xxhash") -> DataFrame:
    """SPL-05: fold id, random (hash of key) or modulo over the order (time series)."""
    if mode == "modulo":
        return seq_number(df, [], [order or key], "_rn").withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(k))).drop("_rn")
    return df.withColumn(out, hash_bucket(F.col(key), seed, k, method))
