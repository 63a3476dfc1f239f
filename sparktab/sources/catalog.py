"""Catalog and query entry points (SRC-09, SRC-10, SQL-01, SQL-09, SQL-12).

Tables are registered as temporary views; a user query is guarded (SELECT
only, fences and EXPLAIN removed, a LIMIT when absent) and handed to
``spark.sql``; Catalyst then plans it like any DataFrame query."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.sources.io import read_table

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


_REGISTERED: dict = {}


def register_tables(spark: SparkSession, base_dir: str, names=None) -> list[str]:
    """Temporary views over the tables of ``base_dir``; a view already
    registered for the same folder in this session is kept."""
    names = list(names or TABLES)
    app = spark.sparkContext.applicationId
    for n in names:
        if _REGISTERED.get((app, n)) == base_dir and spark.catalog.tableExists(n):
            continue
        read_table(spark, base_dir, n).createOrReplaceTempView(n)
        _REGISTERED[(app, n)] = base_dir
    return names


def guard(query: str, limit: int | None = 100, allow_with: bool = False) -> str:
    """SQL-02/03/04 on one text (same rules as ``functions.sqltext``)."""
    q = query.replace("```sql", "").replace("```", "").strip()
    if q.upper().startswith("EXPLAIN"):
        q = q[7:].strip()
    head = q.lstrip().upper()
    if not (head.startswith("SELECT") or (allow_with and head.startswith("WITH"))):
        raise ValueError("only SELECT statements are allowed")
    if limit is not None and "limit" not in q.lower():
        q = f"{q} LIMIT {int(limit)}"
    return q


def run_user_query(spark: SparkSession, base_dir: str, query: str, limit: int | None = 100) -> DataFrame:
    """SQL-01: guarded user SELECT over the registered tables."""
    register_tables(spark, base_dir)
    return spark.sql(guard(query, limit))


def json_safe(df: DataFrame) -> DataFrame:
    """SQL-09: timestamps -> ISO text (fraction only when present), decimals -> double."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            frac = F.date_format(c, "SSSSSS")
            c = F.when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def numeric_promotion_plan(df: DataFrame, cols=None) -> DataFrame:
    """SQL-12: for each text column, promote to double when some value looks
    numeric (`^\\d+\\.?\\d*$`) and every non-null value casts; one aggregation."""
    cols = [c for c in (cols or df.columns) if isinstance(df.schema[c].dataType, T.StringType)]
    aggs = []
    for c in cols:
        looks = F.count_if(F.col(c).rlike(r"^\d+\.?\d*$")) > 0
        all_cast = F.count(F.col(c).try_cast("double")) == F.count(c)
        aggs.append(F.struct(F.lit(c).alias("column_name"), (looks & all_cast).alias("promoted")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def promote_numeric(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Apply a promotion plan (a few rows, one per column) to the frame."""
    promoted = {r["column_name"] for r in plan.where("promoted").collect()}  # at most one row per column
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in promoted else F.col(c) for c in df.columns])


def list_tables(spark: SparkSession, names=None) -> DataFrame:
    """SRC-09: registered tables (temporary views) of the session."""
    rows = [(t.name,) for t in spark.catalog.listTables() if names is None or t.name in names]
    return spark.createDataFrame(rows, "table_name string")


def describe_tables(spark: SparkSession, table_list: str) -> DataFrame:
    """SRC-10: (table, column, type, position) for a comma-separated list of tables."""
    rows = []
    for name in [t.strip() for t in table_list.split(",") if t.strip()]:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"bad table name {name!r}")
        for i, f in enumerate(spark.table(name).schema.fields):
            rows.append((name, f.name, f.dataType.simpleString(), i))
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")


RELATIONAL_TYPES = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver",
                    "sqlite": "org.sqlite.JDBC"}


def read_relational(spark: SparkSession, conn: dict) -> DataFrame:
    """SRC-08: a relational source.  PostgreSQL, MySQL and SQLite go through
    JDBC (filters, columns and limits are pushed to the database; a numeric
    ``partition_column`` with bounds splits the read over executors); the
    ``catalog`` type reads the session's registered tables; others are refused."""
    kind = (conn.get("type") or "").lower()
    if kind == "catalog":
        return spark.sql(conn["query"])
    return spark.read.format("jdbc").options(**jdbc_options(conn)).load()


def jdbc_options(conn: dict) -> dict[str, str]:
    """Options of the JDBC source.  The query is a bracketed subquery in
    ``dbtable``, as Spark doesn't take ``query`` beside ``partitionColumn``."""
    kind = (conn.get("type") or "").lower()
    if kind not in RELATIONAL_TYPES:
        raise ValueError(f"unsupported database type: {kind!r}")
    if kind == "sqlite":
        url = f"jdbc:sqlite:{conn['database']}"
    else:
        port = conn.get("port") or (5432 if kind == "postgresql" else 3306)
        url = f"jdbc:{kind}://{conn['host']}:{port}/{conn['database']}"
    out = {"url": url, "driver": RELATIONAL_TYPES[kind], "dbtable": f"({conn['query'].strip().rstrip(';')}) src",
           "fetchsize": conn.get("fetchsize", 10000)}
    if conn.get("user"):
        out |= {"user": conn["user"], "password": conn.get("password", "")}
    if conn.get("partition_column"):
        out |= {"partitionColumn": conn["partition_column"], "lowerBound": conn["lower_bound"],
                "upperBound": conn["upper_bound"], "numPartitions": conn.get("num_partitions", 64)}
    return {k: str(v) for k, v in out.items()}
