"""Raw files in the reference's shapes, written by Spark from the driver's
tables into the shared checkpoint folder (one landing per session and data
directory, each set when it is first read).  The SQL texts give the same logical lines to the oracle."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparktab.plans import views as V
from sparktab.session import checkpoint_path

_LANDED: dict = {}

DATASETS = ["sales_daily", "sales_category", "invoices", "orders_export", "documents_latin1"]


def land(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> str:
    """The folder of the landing, with at least the data sets ``names`` (None:
    all) written into it.  A set is written once, when a query first reads it."""
    app = spark.sparkContext.applicationId
    base = _LANDED.setdefault((app, sf_dir), checkpoint_path(spark, "landing"))
    for name in names or DATASETS:
        if (app, sf_dir, name) not in _LANDED:
            _WRITERS[name](V.tables(spark, sf_dir), f"{base}/{name}")
            _LANDED[app, sf_dir, name] = f"{base}/{name}"
    return base


def _sales_daily(t, path: str) -> None:
    # A1: headerless, ';', decimal comma
    V.localised(t.orders).select(F.concat_ws(";", "fecha", "monto_total").alias("value")).write.mode("overwrite").text(path)


def _sales_category(t, path: str) -> None:
    # A2: as A1 for one series, every line with five leading blanks
    s = V.daily_series(t.orders).where(F.col("series") == "1-URGENT")
    cents = F.round(F.col("value") * 100).cast("bigint")
    amount = F.when(cents % 100 == 0, (cents / 100).cast("bigint").cast("string")).otherwise(
        F.concat((cents / 100).cast("bigint").cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0")))
    from sparktab.functions.dates import format_localised
    s.select(F.concat(F.lit("     "), format_localised(F.col("d")), F.lit(";"), amount).alias("value")).write.mode("overwrite").text(path)


def _invoices(t, path: str) -> None:
    # A3: invoices with a header, ','
    V.invoices(t.lineitem, t.orders, t.customer).write.mode("overwrite").option("header", True).csv(path)


def _orders_export(t, path: str) -> None:
    # A4: orders export, tab separated, with a header
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    o.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def _documents_latin1(t, path: str) -> None:
    # documents in a single-byte encoding (line breaks inside texts as blanks)
    d = t.documents.select("doc_id", "lang", "source", F.regexp_replace("text", r"[\r\n]+", " ").alias("text"))
    d.write.mode("overwrite").option("header", True).option("sep", "|").option("encoding", "ISO-8859-1").csv(path)


_WRITERS = {"sales_daily": _sales_daily, "sales_category": _sales_category, "invoices": _invoices, "orders_export": _orders_export,
            "documents_latin1": _documents_latin1}


def land_heads(spark: SparkSession, sf_dir: str) -> str:
    """Plain-ASCII documents, 500 ids a file in order of their id: files whose
    heads are known.  A landing of its own, so that no other query writes it."""
    key = (spark.sparkContext.applicationId, sf_dir, "heads")
    if key not in _LANDED:
        path = checkpoint_path(spark, "landing-heads")
        docs = V.tables(spark, sf_dir).documents.select(F.floor(F.col("doc_id") / 500).alias("block"), "doc_id", F.concat_ws(
            "|", F.col("doc_id").cast("string"), "lang", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E]+", "?")).alias("value"))
        docs.repartition("block").sortWithinPartitions("block", "doc_id").select("block", "value").write.mode("overwrite").partitionBy("block").text(path)
        _LANDED[key] = path
    return _LANDED[key]


# logical lines of each landed data set, for the oracle (header lines are
# repeated per file; they leave every per-line mean and count below unchanged)
SQL_LINES = {
    "sales_daily": "SELECT 'sales_daily' AS dataset, fecha || ';' || monto_total AS value FROM localised",
    "sales_category": """SELECT 'sales_category' AS dataset, '     ' || CAST(day(d) AS VARCHAR) || ' ' ||
        ['ene.','feb.','mar.','abr.','may.','jun.','jul.','ago.','sept.','oct.','nov.','dic.'][month(d)] || ' ' || CAST(year(d) AS VARCHAR)
        || ';' || CASE WHEN CAST(round(value * 100) AS BIGINT) % 100 = 0 THEN CAST(CAST(round(value * 100) AS BIGINT) // 100 AS VARCHAR)
                ELSE CAST(CAST(round(value * 100) AS BIGINT) // 100 AS VARCHAR) || ',' || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS value
        FROM daily_series WHERE series = '1-URGENT'""",
    "invoices": """SELECT 'invoices' AS dataset, coalesce(CAST(invoice_key AS VARCHAR), '') || ',' || coalesce(factura_nombre, '') || ','
        || coalesce(CAST(factura_monto_total AS VARCHAR), '') || ',' || coalesce(CAST(factura_total_descuentos AS VARCHAR), '') || ','
        || coalesce(CAST(factura_total_pagos AS VARCHAR), '') || ',' || coalesce(CAST(vendedor_id AS VARCHAR), '') || ','
        || coalesce(cliente_nombre, '') AS value FROM invoices""",
    "orders_export": """SELECT 'orders_export' AS dataset, concat_ws(chr(9), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
        CAST(o_totalprice AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority) AS value FROM orders""",
}
#: header lines of the sets that have one
HEADERS = {"invoices": "invoice_key,factura_nombre,factura_monto_total,factura_total_descuentos,factura_total_pagos,vendedor_id,cliente_nombre",
           "orders_export": "o_orderkey\to_custkey\to_orderstatus\to_totalprice\to_orderdate\to_orderpriority"}


def options_sql(views: str) -> str:
    """CTEs ``lines`` and ``options`` (dataset, separator, decimal, has_header,
    n_columns, n_rows) over the four UTF-8 sets, all from their logical lines.
    A set's first line is its header; without one, any line may be first."""
    heads = " UNION ALL ".join(f"SELECT '{d}' AS dataset, '{h}' AS value" for d, h in HEADERS.items())
    sep = "CASE WHEN m0 >= m1 AND m0 >= m2 AND m0 >= m3 THEN ',' WHEN m1 >= m2 AND m1 >= m3 THEN ';' WHEN m2 >= m3 THEN chr(9) ELSE '|' END"
    return views + ", lines AS (" + " UNION ALL ".join(SQL_LINES.values()) + ")" + f"""
, heads AS ({heads})
, m AS (SELECT dataset, count(*) AS n_rows, avg(len(string_split(value, ','))) AS m0, avg(len(string_split(value, ';'))) AS m1,
               avg(len(string_split(value, chr(9)))) AS m2, avg(len(string_split(value, '|'))) AS m3,
               sum(len(regexp_extract_all(value, '\\d,\\d'))) AS c, sum(len(regexp_extract_all(value, '\\d\\.\\d'))) AS p FROM lines GROUP BY dataset)
, s AS (SELECT *, {sep} AS separator FROM m)
, f AS (SELECT dataset, value FROM heads UNION ALL SELECT dataset, value FROM lines WHERE dataset NOT IN (SELECT dataset FROM heads))
, h AS (SELECT s.dataset, NOT bool_or(len([x FOR x IN string_split(f.value, s.separator)
               IF contains(x, 'nov.') OR contains(x, 'dic.') OR contains(x, ',')]) > 0) AS has_header,
               max(len(string_split(f.value, s.separator))) AS n_columns FROM f JOIN s USING (dataset) GROUP BY s.dataset)
, options AS (SELECT s.dataset, s.separator, CASE WHEN s.c > 2 * s.p THEN ',' ELSE '.' END AS decimal, h.has_header, h.n_columns, s.n_rows
              FROM s JOIN h USING (dataset))
"""
