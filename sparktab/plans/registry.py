"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Results pass through ``canon`` so both engines meet on simple types:
dates and timestamps become ISO strings, small integers become bigint,
decimals become double.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    check: str  # S oracle, P property, R rows only


REGISTRY: dict[str, Entry] = {}


def canon(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def wrap_dates(sql: str, dates) -> str:
    """Cast temporal oracle columns to VARCHAR so both engines meet on ISO text."""
    rep = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def register(name: str, sql: str | None = None, check: str | None = None, dates=()):
    if sql and dates:
        sql = wrap_dates(sql, dates)

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return canon(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(name, build, sql, check or ("S" if sql else "R"))
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # import for the side effect of registering
    from sparktab.plans import (q_core, q_profile, q_clean, q_features, q_models,  # noqa: F401
                                q_telemetry, q_sql, q_stream)
    return REGISTRY
