"""Registered queries: cleaning and editing (CLN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.functions import dates as D
from sparktab.functions import numbers as N
from sparktab.operators import clean as C
from sparktab.plans import sqlfrag as Q
from sparktab.plans import views as V
from sparktab.plans.registry import register


def _loc(spark, sf):
    return V.localised(V.tables(spark, sf).orders)


@register("cln_01_parse_localised_dates", dates=["d", "parsed"], sql=V.with_views("localised") + f"""
SELECT d, fecha, {Q.parse_lenient('fecha')} AS parsed, {Q.parse_lenient('fecha')} = d AS ok FROM localised""")
def cln_01(spark, sf):
    loc = _loc(spark, sf)
    p = D.parse_localised(F.col("fecha"))
    return loc.select("d", "fecha", p.alias("parsed"), (p == F.col("d")).alias("ok"))


@register("cln_02_strict_parse_counts", sql=V.with_views("localised") + f"""
SELECT count(*) AS n_rows, count({Q.parse_strict('fecha')}) AS parsed, count(*) - count({Q.parse_strict('fecha')}) AS failed
FROM localised""")
def cln_02(spark, sf):
    p = D.parse_localised(F.col("fecha"), strict=True)
    return _loc(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.count(p).alias("parsed"),
                               (F.count(F.lit(1)) - F.count(p)).alias("failed"))


@register("cln_03_format_localised", dates=["d"], sql=V.with_views("daily") + """
SELECT d, CAST(day(d) AS VARCHAR) || ' ' ||
  ['ene.','feb.','mar.','abr.','may.','jun.','jul.','ago.','sept.','oct.','nov.','dic.'][month(d)] || ' ' || CAST(year(d) AS VARCHAR) AS fecha_out
FROM daily""")
def cln_03(spark, sf):
    d = V.daily(V.tables(spark, sf).orders)
    return d.select("d", D.format_localised(F.col("d")).alias("fecha_out"))


@register("cln_04_european_numbers", dates=["d"], sql=V.with_views("daily") + """
, s AS (SELECT d, value, translate(format('{:,.2f}', value), ',.', '.,') AS monto_eu FROM daily)
SELECT d, monto_eu, try_cast(replace(replace(replace(monto_eu, '.', ''), ' ', ''), ',', '.') AS DOUBLE) AS parsed,
  try_cast(replace(replace(replace(monto_eu, '.', ''), ' ', ''), ',', '.') AS DOUBLE) = value AS ok FROM s""")
def cln_04(spark, sf):
    d = V.daily(V.tables(spark, sf).orders)
    s = d.withColumn("monto_eu", F.translate(F.format_number("value", 2), ",.", ".,"))
    p = N.parse_european(F.col("monto_eu"))
    return s.select("d", "monto_eu", p.alias("parsed"), (p == F.col("value")).alias("ok"))


@register("cln_05_multi_mark_numbers", dates=["d"], sql=V.with_views("daily") + """
, s AS (SELECT d, value, format('{:,.2f}', value) AS raw, replace(trim(format('{:,.2f}', value)), ',', '.') AS t FROM daily)
SELECT d, raw, try_cast(CASE WHEN instr(t, '.') > 0
    THEN replace(left(t, length(t) - instr(reverse(t), '.')), '.', '') || right(t, instr(reverse(t), '.'))
    ELSE t END AS DOUBLE) AS parsed FROM s""")
def cln_05(spark, sf):
    d = V.daily(V.tables(spark, sf).orders)
    s = d.withColumn("raw", F.format_number("value", 2))
    return s.select("d", "raw", N.parse_multi_mark(F.col("raw")).alias("parsed"))


@register("cln_06_lenient_numeric_cast", sql=V.with_views("localised") + """
SELECT count(*) AS n_rows, count(try_cast(trim(monto_total) AS DOUBLE)) AS numeric_values,
  count(*) - count(try_cast(trim(monto_total) AS DOUBLE)) AS coerced_to_null FROM localised""")
def cln_06(spark, sf):
    v = N.lenient_double(F.col("monto_total"))
    return _loc(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("numeric_values"),
                               (F.count(F.lit(1)) - F.count(v)).alias("coerced_to_null"))


@register("cln_07_trim_values_and_names", dates=["d"], sql=V.with_views("localised") + """
SELECT d, trim('     ' || fecha) AS fecha, trim(monto_total || '  ') AS monto_total FROM localised""")
def cln_07(spark, sf):
    loc = _loc(spark, sf)
    raw = loc.select("d", F.concat(F.lit("     "), "fecha").alias(" fecha "),
                     F.concat("monto_total", F.lit("  ")).alias("monto_total  "))
    return C.trim_all(raw)


@register("cln_08_impute", sql=V.with_views("wide_customer") + """
SELECT customer_id, coalesce(c_name, 'UNKNOWN') AS c_name, c_nationkey,
  coalesce(c_acctbal, (SELECT median(c_acctbal) FROM wide_customer)) AS c_acctbal,
  coalesce(c_mktsegment, 'UNKNOWN') AS c_mktsegment, is_vip, coalesce(source_system, 'UNKNOWN') AS source_system,
  coalesce(contact_email, 'UNKNOWN') AS contact_email, coalesce(empty_note, 'UNKNOWN') AS empty_note
FROM wide_customer""")
def cln_08(spark, sf):
    return C.impute(V.wide_customer(V.tables(spark, sf).customer))


@register("cln_09_drop_nulls", sql=V.with_views("wide_customer") + """
SELECT (SELECT count(*) FROM wide_customer) AS n_rows,
  (SELECT count(*) FROM wide_customer WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL) AS any_null_dropped,
  (SELECT count(*) FROM wide_customer WHERE c_acctbal IS NOT NULL) AS subset_dropped""")
def cln_09(spark, sf):
    w = V.wide_customer(V.tables(spark, sf).customer).drop("empty_note")
    from sparktab.operators.sequence import one_row
    b = one_row(C.drop_nulls(w).agg(F.count(F.lit(1)).alias("n")))["n"]
    c = one_row(C.drop_nulls(w, ["c_acctbal"]).agg(F.count(F.lit(1)).alias("n")))["n"]
    return w.agg(F.count(F.lit(1)).alias("n_rows"), F.first(b).alias("any_null_dropped"), F.first(c).alias("subset_dropped"))


@register("cln_10_quarantine", dates=["d"], sql=V.with_views("localised") + f"""
SELECT d, fecha FROM localised WHERE {Q.parse_strict('fecha')} IS NULL""")
def cln_10(spark, sf):
    loc = _loc(spark, sf).withColumn("parsed", D.parse_localised(F.col("fecha"), strict=True))
    _good, bad = C.quarantine(loc, "parsed")
    return bad.select("d", "fecha")


# ---------------------------------------------------------------- dataset edits
_INV = V.with_views("invoices") + """
, ds AS (SELECT row_number() OVER (ORDER BY invoice_key) - 1 AS _row, invoice_key, factura_nombre, factura_monto_total,
                factura_total_pagos FROM invoices)
"""


def _dataset(spark, sf):
    t = V.tables(spark, sf)
    inv = V.invoices(t.lineitem, t.orders, t.customer).select(
        "invoice_key", "factura_nombre", "factura_monto_total", "factura_total_pagos")
    return C.with_row_index(inv, ["invoice_key"])


@register("cln_11_append_row", sql=_INV + """
SELECT * FROM ds UNION ALL
SELECT (SELECT max(_row) + 1 FROM ds), NULL, 'TOTAL', round(sum(factura_monto_total), 2), NULL FROM ds""")
def cln_11(spark, sf):
    ds = _dataset(spark, sf)
    total = ds.agg(F.lit("TOTAL").alias("factura_nombre"),
                   F.round(F.sum("factura_monto_total"), 2).alias("factura_monto_total"))
    return C.append_rows(ds, total)


@register("cln_12_delete_row", sql=_INV + """
SELECT CASE WHEN _row > 10 THEN _row - 1 ELSE _row END AS _row, invoice_key FROM ds WHERE _row <> 10""")
def cln_12(spark, sf):
    return C.delete_row(_dataset(spark, sf), 10).select("_row", "invoice_key")


@register("cln_13_edit_cell", sql=_INV + """
SELECT _row, invoice_key, CASE WHEN _row = 5 THEN 123.5 ELSE factura_monto_total END AS factura_monto_total FROM ds""")
def cln_13(spark, sf):
    return C.edit_cell(_dataset(spark, sf), 5, "factura_monto_total", "123.5").select(
        "_row", "invoice_key", "factura_monto_total")


@register("cln_14_keyed_replace", sql=_INV + """
, batch AS (SELECT invoice_key, factura_nombre, factura_monto_total * 2 AS factura_monto_total FROM ds WHERE invoice_key % 10 = 0)
, r AS (SELECT invoice_key, factura_nombre, factura_monto_total FROM ds WHERE invoice_key NOT IN (SELECT invoice_key FROM batch)
        UNION ALL SELECT * FROM batch)
SELECT count(*) AS n_rows, round(sum(factura_monto_total), 2) AS total_amount FROM r""")
def cln_14(spark, sf):
    ds = _dataset(spark, sf).select("invoice_key", "factura_nombre", "factura_monto_total")
    batch = ds.where(F.pmod("invoice_key", F.lit(10)) == 0).withColumn("factura_monto_total", F.col("factura_monto_total") * 2)
    r = C.replace_rows(ds, batch, ["invoice_key"])
    return r.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("factura_monto_total"), 2).alias("total_amount"))


@register("cln_14_replace_all", sql=_INV + """
SELECT _row, invoice_key, factura_nombre, factura_monto_total * 2 AS factura_monto_total, CAST(NULL AS DOUBLE) AS factura_total_pagos
FROM ds WHERE invoice_key % 10 <> 0""")
def cln_14_all(spark, sf):
    """The edited batch (rows deleted, amounts changed, a column left out) is the new data set."""
    ds = _dataset(spark, sf)
    batch = ds.where(F.pmod("invoice_key", F.lit(10)) != 0).withColumn("factura_monto_total", F.col("factura_monto_total") * 2)
    r = C.replace_rows(ds, batch.drop("factura_total_pagos"))
    return r.withColumn("factura_total_pagos", F.col("factura_total_pagos").cast("double"))


@register("cln_13_edit_cell_text", sql=_INV + """
SELECT _row, invoice_key, CASE WHEN _row = 7 THEN '1e5' ELSE CAST(invoice_key AS VARCHAR) END AS edited FROM ds""")
def cln_13_text(spark, sf):
    """A text put into a number column makes it a text column."""
    ds = _dataset(spark, sf).withColumn("edited", F.col("invoice_key"))
    return C.edit_cell(ds, 7, "edited", "1e5").select("_row", "invoice_key", "edited")


# ---------------------------------------------------------------- cascades
_CASCADE_SQL = V.with_views("jobs", "models", "agent_events", "agent_messages", "agent_statistics", "exec_logs") + """
, doomed AS (SELECT id FROM jobs WHERE status = 'failed' AND NOT is_parent)
"""


def _tracking(spark, sf):
    t = V.tables(spark, sf)
    jobs = V.jobs(t.orders)
    children = {"models": V.models(t.lineitem), "logs": V.agent_events(t.events),
                "agent_messages": V.agent_messages(t.conversations),
                "agent_statistics": V.agent_statistics(t.conversations),
                "generated_scripts": V.exec_logs(t.events)}
    doomed = jobs.where((F.col("status") == "failed") & ~F.col("is_parent")).select("id")
    return jobs, children, doomed


@register("cln_15_cascade_delete", sql=_CASCADE_SQL + """
SELECT 'jobs' AS table_name, 'job' AS cascade, count(*) AS remaining FROM jobs WHERE id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'models', 'job', count(*) FROM models WHERE job_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'logs', 'job', count(*) FROM agent_events WHERE job_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'agent_messages', 'version', count(*) FROM agent_messages WHERE job_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'agent_statistics', 'version', count(*) FROM agent_statistics WHERE job_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'generated_scripts', 'version', count(*) FROM exec_logs WHERE job_id NOT IN (SELECT id FROM doomed)""")
def cln_15(spark, sf):
    """Job cascade (models, logs; predictions) and version cascade (adds
    messages, statistics, reports, scripts) applied to failed non-parent jobs."""
    jobs, children, doomed = _tracking(spark, sf)
    narrow = C.cascade_delete(jobs, {k: children[k] for k in ("models", "logs")}, doomed)
    wide = C.cascade_delete(jobs, children, doomed)
    parts = [narrow["jobs"].agg(F.lit("jobs").alias("table_name"), F.lit("job").alias("cascade"),
                                F.count(F.lit(1)).alias("remaining"))]
    for k in ("models", "logs"):
        parts.append(narrow[k].agg(F.lit(k).alias("table_name"), F.lit("job").alias("cascade"), F.count(F.lit(1)).alias("remaining")))
    for k in ("agent_messages", "agent_statistics", "generated_scripts"):
        parts.append(wide[k].agg(F.lit(k).alias("table_name"), F.lit("version").alias("cascade"), F.count(F.lit(1)).alias("remaining")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_CHILD_SQL = {"predictions": "SELECT l_orderkey AS job_id FROM lineitem WHERE l_returnflag <> 'R'", "models": "SELECT job_id FROM models", "logs": "SELECT job_id FROM agent_events",
              "agent_messages": "SELECT job_id FROM agent_messages", "agent_statistics": "SELECT job_id FROM agent_statistics",
              "process_reports": "SELECT DISTINCT job_id FROM agent_statistics", "generated_scripts": "SELECT job_id FROM exec_logs"}


def _cascade_counts_sql(label: str, names: list[str]) -> str:
    parts = [("jobs", "SELECT id AS job_id FROM jobs"), *[(n, _CHILD_SQL[n]) for n in names]]
    return " UNION ALL ".join(
        f"SELECT '{label}' AS cascade, '{n}' AS table_name, count(*) FILTER (WHERE d.id IS NULL) AS remaining, count(d.id) AS deleted "
        f"FROM ({q}) t LEFT JOIN doomed d ON t.job_id = d.id" for n, q in parts)


@register("cln_15_both_cascades", sql=_CASCADE_SQL + _cascade_counts_sql("job", C.JOB_CASCADE) + " UNION ALL " + _cascade_counts_sql("version", C.VERSION_CASCADE))
def cln_15_both(spark, sf):
    """Rows left and deleted in every table of both cascades: three child
    tables for a job, seven for a version."""
    jobs, children, doomed = _tracking(spark, sf)
    li = V.tables(spark, sf).lineitem
    children |= {"predictions": li.where(F.col("l_returnflag") != "R").select(F.col("l_orderkey").alias("job_id"), "l_linenumber"),
                 "process_reports": children["agent_statistics"].select("job_id").distinct()}
    out = [C.cascade_counts(jobs, children, doomed, names).withColumn("cascade", F.lit(label))
           for label, names in (("job", C.JOB_CASCADE), ("version", C.VERSION_CASCADE))]
    return out[0].unionByName(out[1])


@register("cln_16_orphan_audit", sql=_CASCADE_SQL + """
, kept AS (SELECT id FROM jobs WHERE id NOT IN (SELECT id FROM doomed))
SELECT 'agent_messages' AS table_name, count(*) AS orphans FROM agent_messages WHERE job_id NOT IN (SELECT id FROM kept)
UNION ALL SELECT 'agent_statistics', count(*) FROM agent_statistics WHERE job_id NOT IN (SELECT id FROM kept)
UNION ALL SELECT 'generated_scripts', count(*) FROM exec_logs WHERE job_id NOT IN (SELECT id FROM kept)""")
def cln_16(spark, sf):
    """Rows the narrow (job) cascade leaves behind: children without a job."""
    jobs, children, doomed = _tracking(spark, sf)
    narrow = C.cascade_delete(jobs, {}, doomed)
    out = None
    for k in ("agent_messages", "agent_statistics", "generated_scripts"):
        o = C.orphans(children[k], narrow["jobs"]).agg(F.lit(k).alias("table_name"), F.count(F.lit(1)).alias("orphans"))
        out = o if out is None else out.unionByName(o)
    return out


@register("cln_17_add_missing_column", sql=V.with_views("query_log") + """
SELECT coalesce(generation_type, 'manual') AS generation_type, count(*) AS n FROM (
  SELECT q_id, CAST(NULL AS VARCHAR) AS generation_type FROM query_log) GROUP BY 1""")
def cln_17(spark, sf):
    ql = V.query_log(V.tables(spark, sf).orders)
    m = C.add_missing_column(ql, "generation_type", None, "string")
    m = C.add_missing_column(m, "generation_type", "never-used")  # present now: unchanged
    return m.groupBy(F.coalesce("generation_type", F.lit("manual")).alias("generation_type")).agg(
        F.count(F.lit(1)).alias("n"))


@register("udf_01_native_row_functions", dates=["d", "parsed_date"], sql=V.with_views("localised") + f"""
SELECT d, {Q.parse_lenient('fecha')} AS parsed_date,
  try_cast(replace(replace(replace(monto_total, '.', ''), ' ', ''), ',', '.') AS DOUBLE) AS parsed_amount,
  CASE WHEN split_part(fecha, ' ', 2) = '' THEN 'UNKNOWN' ELSE split_part(fecha, ' ', 2) END AS month_token
FROM localised""")
def udf_01(spark, sf):
    """Row functions of the reference's per-row apply (localised dates, numbers,
    prefixes) as native column expressions: no Python UDF in the plan."""
    loc = _loc(spark, sf)
    tok = F.split("fecha", " ").getItem(1)
    return loc.select("d", D.parse_localised(F.col("fecha")).alias("parsed_date"),
                      N.parse_european(F.col("monto_total")).alias("parsed_amount"),
                      F.when(F.coalesce(tok, F.lit("")) == "", F.lit("UNKNOWN")).otherwise(tok).alias("month_token"))
