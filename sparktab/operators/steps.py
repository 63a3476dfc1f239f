"""User preprocessing steps (UDF-02) and model-input helpers (FEA-15/16/17/20).

A step is any ``DataFrame -> DataFrame`` function; ``Steps`` keeps them in
order and applies them with ``DataFrame.transform``, so the whole chain is
one lazy plan that Catalyst optimises together."""

from __future__ import annotations

from typing import Callable

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparktab.operators.profile import correlations, profile


class Steps:
    def __init__(self):
        self._steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def add_step(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> "Steps":
        self._steps.append((name, fn))
        return self

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self._steps]

    def run(self, df: DataFrame) -> DataFrame:
        for _name, fn in self._steps:
            df = df.transform(fn)
        return df


def encode_categoricals(df: DataFrame, cols: list[str]):
    """FEA-15: StringIndexer (unseen -> extra index) + OneHotEncoder; returns
    (frame with `{c}_idx` and `{c}_ohe`, fitted stages)."""
    idx = StringIndexer(inputCols=cols, outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep").fit(df)
    out = idx.transform(df)
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_ohe" for c in cols],
                        handleInvalid="keep").fit(out)
    return ohe.transform(out), (idx, ohe)


def hot_place(vector: Column) -> Column:
    """Place of the one in a vector of ``OneHotEncoder``, from 0; null if it has none."""
    return F.get(F.unwrap_udt(vector)["indices"], F.lit(0))


def one_hot_text(place: Column, size: Column) -> Column:
    """The first ``size`` digits of a one-hot vector as a text; only zeros if its one is not among them."""
    zeros = lambda n: F.repeat(F.lit("0"), n.cast("int"))
    return F.when(place < size, F.concat(zeros(place), F.lit("1"), zeros(size - place - 1))).otherwise(zeros(size))


def flagged_categoricals(df: DataFrame, cols: list[str] | None = None, categorical_ratio: float = 0.05) -> list[str]:
    """FEA-15: the text columns whose distinct values are at most
    ``categorical_ratio`` of the rows (PRF-20), in column order; an empty or
    all-null column is none of them.  One row per column reaches the driver."""
    texts = [c for c in cols or df.columns if isinstance(df.schema[c].dataType, StringType)]
    if not texts:
        return []
    flags = profile(df, texts).where((F.col("unique_ratio") <= categorical_ratio) & (F.col("n_unique") > 0)).select("column_name").collect()
    return [c for c in texts if c in {r["column_name"] for r in flags}]


def feature_list(df: DataFrame, target: str, drop: tuple[str, ...] = ()) -> list[str]:
    """FEA-16: every column but the target and the raw date/identifier columns."""
    return [c for c in df.columns if c != target and c not in drop]


def align_columns(df: DataFrame, expected: list[str], fill=0) -> DataFrame:
    """FEA-17: the scoring frame with exactly the model's columns, in order;
    missing columns are filled with ``fill``."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in expected])


def drop_correlated(df: DataFrame, cols: list[str], thr: float = 0.95) -> list[str]:
    """FEA-20: for each pair with |r| > thr, the later name is dropped.
    The correlations come from one aggregation (at most len(cols)^2 rows)."""
    pairs = correlations(df, cols, thr).where("is_high").collect()  # bounded by the number of column pairs
    gone = set()
    for r in pairs:
        if r["col_a"] not in gone:
            gone.add(r["col_b"])
    return [c for c in cols if c not in gone]
