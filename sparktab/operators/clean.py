"""Cleaning and editing (CLN-*): imputation, null handling, quarantine,
row/cell edits on a stable row index, keyed replacement, cascades and
orphan audits, schema migration.

Edits never use positions that depend on partitioning: a dataset gets a
stable 0-based ``_row`` index once, at ingest (``with_row_index``), computed
by range-partitioned numbering (no single-task window)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.operators.quantiles import exact_quantiles
from sparktab.operators.sequence import one_row, seq_number

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def trim_all(df: DataFrame) -> DataFrame:
    """CLN-07: trimmed column names and trimmed string values."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.trim(c)
        cols.append(c.alias(f.name.strip()))
    return df.select(*cols)


def impute(df: DataFrame, cols=None, fill_text: str = "UNKNOWN", approx: bool = False) -> DataFrame:
    """CLN-08: numeric nulls -> median, other nulls -> 'UNKNOWN'.

    All exact medians come from one rank selection (``exact_quantiles``);
    ``approx=True`` uses ``percentile_approx`` instead."""
    cols = list(cols or df.columns)
    num = [c for c in cols if isinstance(df.schema[c].dataType, NUMERIC)]
    txt = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    med = None
    if num:
        med = one_row(df.agg(*[F.percentile_approx(c, 0.5, 100000).alias(f"_med_{c}") for c in num]) if approx
                      else exact_quantiles(df, {f"_med_{c}": (c, 0.5) for c in num}))
    out = []
    for f in df.schema.fields:
        c = f.name
        col = F.col(c)
        if c in num:
            col = F.coalesce(col, med[f"_med_{c}"].cast(f.dataType)).alias(c)
        elif c in txt:
            col = F.coalesce(col, F.lit(fill_text)).alias(c)
        out.append(col)
    return df.select(*out)


def drop_nulls(df: DataFrame, subset=None) -> DataFrame:
    """CLN-09: rows with any null, or with a null in ``subset``."""
    return df.na.drop(how="any", subset=subset)


def quarantine(df: DataFrame, parsed: str) -> tuple[DataFrame, DataFrame]:
    """CLN-10: (good, rejected) split on a parsed column being null."""
    return df.where(F.col(parsed).isNotNull()), df.where(F.col(parsed).isNull())


def with_row_index(df: DataFrame, order: list[str], out: str = "_row") -> DataFrame:
    """Stable 0-based row index by ``order`` (unique), without a global window."""
    return seq_number(df, [], order, out).withColumn(out, F.col(out) - 1)


def append_rows(df: DataFrame, rows: DataFrame, index: str = "_row") -> DataFrame:
    """CLN-11: append rows; missing columns become null; new rows continue the index."""
    base = one_row(df.agg(F.coalesce(F.max(index), F.lit(-1)).alias("_base")))["_base"]
    if index in rows.columns:
        rows = rows.drop(index)
    new = seq_number(rows, [], [F.xxhash64(*[F.col(c) for c in rows.columns])] + list(rows.columns), "_k")
    new = new.withColumn(index, base + F.col("_k")).drop("_k")
    return df.unionByName(new, allowMissingColumns=True)


def _check_position(df: DataFrame, i: int, index: str) -> None:
    n = df.agg(F.max(index)).first()[0]  # positions run from 0 without gaps
    if i < 0 or n is None or i > n:
        raise IndexError(f"no row {i}")


def delete_row(df: DataFrame, i: int, index: str = "_row") -> DataFrame:
    """CLN-12: delete the row at 0-based position ``i``; positions after it shift
    down.  A position outside the data set is an ``IndexError``."""
    _check_position(df, i, index)
    return (df.where(F.col(index) != i)
            .withColumn(index, F.when(F.col(index) > i, F.col(index) - 1).otherwise(F.col(index))))


def typed_literal(value: str):
    """Digits are an int, digits with a sign or a point a float, all else
    (``1e5``, ``nan``, blanks, ``1_000``) is text."""
    if re.fullmatch(r"\d+", value):
        return int(value) if int(value) < 1 << 63 else float(value)
    return float(value) if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", value) else value


def edit_cell(df: DataFrame, i: int, column: str, value: str, index: str = "_row") -> DataFrame:
    """CLN-13: set one cell to the typed value.  A column that can't hold it is
    widened, never nulled: to double for a number, to text for a text.  A
    position outside the data set is an ``IndexError``."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    _check_position(df, i, index)
    t, v = df.schema[column].dataType, typed_literal(value)
    number, numeric = not isinstance(v, str), isinstance(t, T.NumericType)
    if number and numeric:
        kept = df.sparkSession.range(1).select(F.lit(v).try_cast(t)).first()[0]  # one value
        t = t if kept is not None and float(kept) == float(v) else T.DoubleType()
    elif not isinstance(t, T.StringType):
        fits = not number and not numeric and df.sparkSession.range(1).select(F.lit(v).try_cast(t)).first()[0] is not None
        t = t if fits else T.StringType()
    return df.withColumn(column, F.when(F.col(index) == i, F.lit(v).cast(t)).otherwise(F.col(column).cast(t)))


def replace_rows(df: DataFrame, batch: DataFrame, key: list[str] | None = None) -> DataFrame:
    """CLN-14: the edited batch replaces the whole data set, in its columns
    (missing ones null, further ones kept).  With ``key`` only rows whose key
    is in the batch are replaced and new keys appended (anti join + union)."""
    kept = df.join(batch.select(*key), key, "left_anti") if key else df.limit(0)
    return kept.unionByName(batch, allowMissingColumns=True)


# fixed values (must equal the reference's): child tables that each cascade deletes from
JOB_CASCADE = ["predictions", "models", "logs"]
VERSION_CASCADE = ["predictions", "models", "logs", "agent_messages", "agent_statistics", "process_reports", "generated_scripts"]


def cascade_counts(parent: DataFrame, children: dict[str, DataFrame], doomed: DataFrame, cascade: list[str],
                   parent_key: str = "id", child_key: str = "job_id") -> DataFrame:
    """CLN-15 audit: (table_name, remaining, deleted) of the parent and of
    every child in ``cascade``; a table with no row of a doomed job has 0
    deleted.  A row without a job stays.  A child that isn't given is refused."""
    lacking = [c for c in cascade if c not in children]
    if lacking:
        raise ValueError(f"no table for {lacking}")
    kept = cascade_delete(parent, {c: children[c] for c in cascade}, doomed, parent_key, child_key)
    out = None
    for name in ["jobs", *cascade]:
        before = parent if name == "jobs" else children[name]
        one = (kept[name].select(F.lit(1).alias("_r"), F.lit(0).alias("_a")).unionAll(before.select(F.lit(0), F.lit(1)))
               .agg(F.coalesce(F.sum("_r"), F.lit(0)).alias("remaining"), F.coalesce(F.sum("_a") - F.sum("_r"), F.lit(0)).alias("deleted")))
        one = one.select(F.lit(name).alias("table_name"), "remaining", "deleted")
        out = one if out is None else out.unionAll(one)
    return out


def cascade_delete(parent: DataFrame, children: dict[str, DataFrame], doomed: DataFrame,
                   parent_key: str = "id", child_key: str = "job_id") -> dict[str, DataFrame]:
    """CLN-15: delete the ``doomed`` ids from the parent and every listed child."""
    ids = doomed.select(F.col(parent_key).alias("_del")).distinct()
    out = {"jobs": parent.join(ids, parent[parent_key] == ids["_del"], "left_anti")}
    for name, ch in children.items():
        out[name] = ch.join(ids, ch[child_key] == ids["_del"], "left_anti")
    return out


def orphans(child: DataFrame, parent: DataFrame, child_key: str = "job_id", parent_key: str = "id") -> DataFrame:
    """CLN-16: child rows whose parent id no longer exists."""
    p = parent.select(F.col(parent_key).alias("_pid"))
    return child.join(p, child[child_key] == p["_pid"], "left_anti")


def add_missing_column(df: DataFrame, name: str, default=None, dtype: str = "string") -> DataFrame:
    """CLN-17: add a column with a default when it is absent (schema migration)."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(default).cast(dtype))
