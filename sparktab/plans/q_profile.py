"""Registered queries: profiling and data quality (PRF-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.operators import profile as P
from sparktab.plans import landing as L
from sparktab.plans import sqlfrag as Q
from sparktab.plans import views as V
from sparktab.plans.registry import register

WIDE_COLS = [("customer_id", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
             ("c_mktsegment", "string"), ("is_vip", "int"), ("source_system", "string"),
             ("contact_email", "string"), ("empty_note", "string")]
ORDER_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
              ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
EVENT_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
              ("value", "double"), ("props", "string")]


def _wide(spark, sf):
    return V.wide_customer(V.tables(spark, sf).customer)


@register("prf_01_profile_wide", sql=V.with_views("wide_customer") + Q.profile_sql("wide_customer", WIDE_COLS))
def prf_01_wide(spark, sf):
    """One-pass exact profile of a frame with planted nulls."""
    return P.profile(_wide(spark, sf))


@register("prf_01_profile_orders", sql=Q.profile_sql("orders", ORDER_COLS))
def prf_01_orders(spark, sf):
    return P.profile(V.tables(spark, sf).orders)


@register("prf_01_profile_events", sql=Q.profile_sql("events", EVENT_COLS))
def prf_01_events(spark, sf):
    return P.profile(V.tables(spark, sf).events)


@register("prf_02_date_candidates", sql=V.with_views("localised") + f"""
, s AS (SELECT fecha, monto_total, CAST(d AS VARCHAR) AS d_iso,
          CASE WHEN day(d) % 3 = 0 THEN 'n/a' ELSE strftime(d, '%d/%m/%Y') END AS d_slash FROM localised)
SELECT * FROM (
  SELECT 'fecha' AS column_name, round(sum(CAST(coalesce({Q.parse_generic('fecha')}, {Q.parse_strict('fecha')}) IS NOT NULL AS BIGINT)) / greatest(count(*), 1), 3) AS ratio FROM s
  UNION ALL SELECT 'monto_total', round(sum(CAST(coalesce({Q.parse_generic('monto_total')}, {Q.parse_strict('monto_total')}) IS NOT NULL AS BIGINT)) / greatest(count(*), 1), 3) FROM s
  UNION ALL SELECT 'd_iso', round(sum(CAST(coalesce({Q.parse_generic('d_iso')}, {Q.parse_strict('d_iso')}) IS NOT NULL AS BIGINT)) / greatest(count(*), 1), 3) FROM s
  UNION ALL SELECT 'd_slash', round(sum(CAST(coalesce({Q.parse_generic('d_slash')}, {Q.parse_strict('d_slash')}) IS NOT NULL AS BIGINT)) / greatest(count(*), 1), 3) FROM s
) t, (SELECT 0.75 AS th) x
""".replace("SELECT * FROM (", "SELECT column_name, ratio, ratio >= th AS is_date FROM ("))
def prf_02(spark, sf):
    loc = V.localised(V.tables(spark, sf).orders)
    s = loc.select("fecha", "monto_total", F.col("d").cast("string").alias("d_iso"),
                   F.when(F.dayofmonth("d") % 3 == 0, F.lit("n/a")).otherwise(F.date_format("d", "dd/MM/yyyy")).alias("d_slash"))
    return P.date_candidates(s, thresh=0.75)


@register("prf_02_date_candidates_empty", sql=V.with_views("wide_customer") + f"""
SELECT 'empty_note' AS column_name, round(sum(CAST(coalesce({Q.parse_generic('empty_note')}, {Q.parse_strict('empty_note')}) IS NOT NULL AS BIGINT)) / greatest(count(*), 1), 3) AS ratio,
  sum(CAST(coalesce({Q.parse_generic('empty_note')}, {Q.parse_strict('empty_note')}) IS NOT NULL AS BIGINT)) / greatest(count(*), 1) >= 0.75 AS is_date FROM wide_customer""")
def prf_02_empty(spark, sf):
    """A text column without values has the date share 0."""
    return P.date_candidates(_wide(spark, sf), ["empty_note"])


@register("prf_12_mixed_type_empty", sql=V.with_views("wide_customer") + """
SELECT 'empty_note' AS column_name, count(TRY_CAST(empty_note AS DOUBLE)) / nullif(count(empty_note), 0) AS numeric_share,
  coalesce(count(TRY_CAST(empty_note AS DOUBLE)) BETWEEN 1 AND count(empty_note) - 1, false) AS is_mixed FROM wide_customer""")
def prf_12_empty(spark, sf):
    """A text column without values has no numeric share and isn't mixed."""
    return P.mixed_type(_wide(spark, sf), ["empty_note"])


@register("prf_04_short_summary", sql="""
SELECT (SELECT count(*) FROM orders) AS n_rows, 6 AS n_cols,
  (SELECT count(*) - count(o_orderpriority) FROM orders) AS nulls_priority,
  o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5""")
def prf_04(spark, sf):
    """Short summary: row and column counts, nulls, first five rows by key."""
    o = V.tables(spark, sf).orders
    from sparktab.operators.sequence import one_row
    stats = one_row(o.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("o_orderpriority").isNull()).alias("nulls")))
    head = o.orderBy("o_orderkey").limit(5).select("o_orderkey", "o_orderstatus")
    return head.select(stats["n_rows"].alias("n_rows"), F.lit(len(o.columns)).alias("n_cols"),
                       stats["nulls"].alias("nulls_priority"), "o_orderkey", "o_orderstatus")


@register("prf_05_describe", sql="""
SELECT * FROM (
""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
    for c in ["l_quantity", "l_discount", "l_tax"]) + ")")
def prf_05(spark, sf):
    """describe() of bounded-cardinality measures: exact quartiles."""
    d = P.describe(V.tables(spark, sf).lineitem, ["l_quantity", "l_discount", "l_tax"])
    return d.select("column_name", "count", *[F.round(c, 6).alias(c) for c in ["mean", "std"]], "min",
                    *[F.round(c, 6).alias(c) for c in ["p25", "p50", "p75"]], "max")


@register("prf_06_target_stats", sql=V.with_views("daily") + """
SELECT min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
  count(value) AS count, count(*) - count(value) AS nulls FROM daily""")
def prf_06(spark, sf):
    r = P.target_stats(V.daily(V.tables(spark, sf).orders), "value")
    return r.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@register("prf_07_missing_pct", sql=V.with_views("wide_customer") + """
SELECT column_name, missing_pct FROM (""" + Q.profile_sql("wide_customer", WIDE_COLS) + ")")
def prf_07(spark, sf):
    return P.profile(_wide(spark, sf)).select("column_name", "missing_pct")


@register("prf_08_date_range", dates=["start_date", "end_date"], sql=V.with_views("daily_series") + """
SELECT series, min(d) AS start_date, max(d) AS end_date, datediff('day', min(d), max(d)) AS span_days
FROM daily_series GROUP BY series""")
def prf_08(spark, sf):
    return P.date_range(V.daily_series(V.tables(spark, sf).orders), "d", ["series"])


@register("prf_09_missing_dates", dates=["d"], sql=V.with_views("daily_series") + """
, r AS (SELECT series, min(d) AS s, max(d) AS e FROM daily_series GROUP BY series)
, spine AS (SELECT series, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS d FROM r)
SELECT series, d FROM spine WHERE NOT EXISTS (SELECT 1 FROM daily_series x WHERE x.series = spine.series AND x.d = spine.d)""")
def prf_09(spark, sf):
    return P.missing_dates(V.daily_series(V.tables(spark, sf).orders), "d", ["series"])


@register("prf_09_gap_summary", sql=V.with_views("daily") + """
SELECT count(*) AS n_rows, datediff('day', min(d), max(d)) + 1 AS calendar_days,
  datediff('day', min(d), max(d)) + 1 <> count(*) AS has_missing_dates FROM daily""")
def prf_09_summary(spark, sf):
    return P.gap_summary(V.daily(V.tables(spark, sf).orders), "d")


@register("prf_10_duplicate_dates", sql="""
SELECT count(*) - count(DISTINCT coalesce(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), chr(0))) AS duplicates FROM orders""")
def prf_10(spark, sf):
    o = V.tables(spark, sf).orders.select(F.to_date("o_orderdate").alias("d"))
    return P.duplicate_count(o, ["d"])


_FLAGS_SQL = V.with_views("wide_customer") + """
, p AS (""" + Q.profile_sql("wide_customer", WIDE_COLS) + """)
SELECT column_name, dtype, missing = n_rows AS is_empty, n_unique = 1 AS is_constant,
  unique_ratio > 0.9 AND NOT regexp_matches(dtype, '^(tinyint|smallint|int|bigint|float|double|decimal)') AS high_cardinality,
  missing / n_rows > 0.05 AS null_warning, unique_ratio <= 0.05 AS is_categorical,
  CASE WHEN ends_with(lower(column_name), '_id') OR ends_with(lower(column_name), 'key') THEN 'identifier'
       WHEN contains(lower(column_name), 'email') THEN 'email' WHEN contains(lower(column_name), 'phone') THEN 'phone' END AS name_role,
  regexp_matches(dtype, '^(tinyint|smallint|int|bigint|float|double|decimal)') AND n_unique > 1
    AND NOT (ends_with(lower(column_name), '_id') OR ends_with(lower(column_name), 'key') OR contains(lower(column_name), 'email') OR contains(lower(column_name), 'phone'))
    AND missing / n_rows <= 0.05 AS target_candidate
FROM p"""


@register("prf_11_15_17_20_25_quality_flags", sql=_FLAGS_SQL)
def prf_flags(spark, sf):
    """Constant / empty / high-cardinality / null-warning / categorical flags,
    role by name and target candidates from one profile."""
    return P.quality_flags(P.profile(_wide(spark, sf)))


@register("prf_11_duplicate_rows", sql="""
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)) AS duplicates FROM orders""")
def prf_11_dups(spark, sf):
    o = V.tables(spark, sf).orders
    return P.duplicate_count(o, ["o_orderstatus", "o_orderpriority"])


@register("prf_12_mixed_type", sql=V.with_views("localised") + """
SELECT 'fecha' AS column_name, count(try_cast(fecha AS DOUBLE)) / count(fecha) AS numeric_share FROM localised
UNION ALL SELECT 'monto_total', count(try_cast(monto_total AS DOUBLE)) / count(monto_total) FROM localised""".replace(
    "SELECT 'fecha'", "SELECT *, numeric_share > 0 AND numeric_share < 1 AS is_mixed FROM (SELECT 'fecha'") + ")")
def prf_12(spark, sf):
    loc = V.localised(V.tables(spark, sf).orders).select("fecha", "monto_total")
    return P.mixed_type(loc)


@register("prf_13_outliers", sql="""
WITH s AS (SELECT avg(l_extendedprice) AS m1, stddev_samp(l_extendedprice) AS s1,
                  avg(l_quantity) AS m2, stddev_samp(l_quantity) AS s2 FROM lineitem)
SELECT 'l_extendedprice' AS column_name, count(*) FILTER (WHERE abs(l_extendedprice - m1) > 3 * s1) AS outliers FROM lineitem, s
UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE abs(l_quantity - m2) > 3 * s2) FROM lineitem, s""")
def prf_13(spark, sf):
    return P.outlier_counts(V.tables(spark, sf).lineitem, ["l_extendedprice", "l_quantity"])


@register("prf_14_high_correlations", sql="""
SELECT * FROM (
  SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem
  UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem)""".replace(
    "SELECT * FROM (", "SELECT *, abs(r) > 0.7 AS is_high FROM ("))
def prf_14(spark, sf):
    r = P.correlations(V.tables(spark, sf).lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.7)
    return r.withColumn("r", F.round("r", 6))


@register("prf_16_column_roles", sql=V.with_views("wide_customer") + """
, vc AS (""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM wide_customer WHERE {c} IS NOT NULL GROUP BY 2"
    for c, _ in WIDE_COLS) + """)
, mode AS (SELECT column_name, value AS mode FROM (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rk FROM vc) WHERE rk = 1)
, tr AS (SELECT column_name, sum(n) FILTER (WHERE value = (SELECT max(value) FROM vc v2 WHERE v2.column_name = vc.column_name)) / sum(n) AS true_ratio FROM vc GROUP BY column_name)
, p AS (""" + Q.profile_sql("wide_customer", WIDE_COLS) + """)
, r AS (SELECT column_name, CASE WHEN dtype IN ('date', 'timestamp', 'timestamp_ntz') THEN 'datetime' WHEN n_unique = 2 THEN 'binary'
          WHEN regexp_matches(dtype, '^(tinyint|smallint|int|bigint|float|double|decimal|boolean)') AND unique_ratio > 0.05 THEN 'numeric'
          ELSE 'categorical' END AS role FROM p)
SELECT r.column_name, role, CASE WHEN role = 'binary' THEN round(true_ratio, 4) END AS true_ratio,
  CASE WHEN role = 'categorical' THEN mode END AS mode
FROM r LEFT JOIN mode USING (column_name) LEFT JOIN tr USING (column_name)""")
def prf_16(spark, sf):
    return P.column_roles(_wide(spark, sf))


@register("prf_18_completeness", sql=V.with_views("wide_customer") + """
SELECT round((""" + " + ".join(f"count({c})" for c, _ in WIDE_COLS) + f""") / (count(*) * {len(WIDE_COLS)}), 6) AS completeness
FROM wide_customer""")
def prf_18(spark, sf):
    return P.completeness(_wide(spark, sf)).select(F.round("completeness", 6).alias("completeness"))


@register("prf_19_problem_type", sql=V.with_views("jobs") + """
SELECT CASE WHEN target_column IS NULL OR trim(target_column) = '' THEN 'unsupervised'
            WHEN target_column IN ('monto_total', 'o_totalprice') THEN 'regression' ELSE 'classification' END AS problem_type,
       count(*) AS n_jobs
FROM jobs GROUP BY 1""")
def prf_19(spark, sf):
    j = V.jobs(V.tables(spark, sf).orders)
    numeric_targets = ["monto_total", "o_totalprice"]  # numeric columns of the job's data set
    pt = P.problem_type(F.col("target_column"), F.col("target_column").isin(*numeric_targets))
    return j.groupBy(pt.alias("problem_type")).agg(F.count(F.lit(1)).alias("n_jobs"))


_TARGETS = ["", "invoice_key", "factura_nombre", " factura_monto_total ", "factura_total_pagos", "vendedor_id", "cliente_nombre", "no_such_column"]


@register("prf_19_by_schema", sql=V.with_views("invoices") + f"""
, ty AS ({" UNION ALL ".join(f"SELECT '{c.strip()}' AS name, (SELECT any_value(typeof({c.strip()})) FROM invoices) AS t" for c in _TARGETS if c.strip() and c != "no_such_column")})
, j AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE [{", ".join(f"'{c}'" for c in _TARGETS)}][o_orderkey % 8 + 1] END AS target_column FROM orders)
SELECT target_column, CASE WHEN target_column IS NULL OR trim(target_column) = '' THEN 'unsupervised' WHEN t IS NULL THEN NULL
         WHEN t = 'VARCHAR' THEN 'classification' ELSE 'regression' END AS problem_type, count(*) AS n_jobs
FROM j LEFT JOIN ty ON trim(target_column) = name GROUP BY ALL""")
def prf_19_schema(spark, sf):
    """Problem type of every job from the type of its target in the data
    set's schema; empty and unknown targets are there too."""
    t = V.tables(spark, sf)
    k = F.col("o_orderkey")
    pick = F.element_at(F.array(*map(F.lit, _TARGETS)), (F.pmod(k, F.lit(8)) + 1).cast("int"))
    jobs = t.orders.select(F.when(F.pmod(k, F.lit(11)) != 0, pick).alias("target_column"))
    p = P.problem_types(jobs, V.invoices(t.lineitem, t.orders, t.customer))
    return p.groupBy("target_column", "problem_type").agg(F.count(F.lit(1)).alias("n_jobs"))


@register("prf_21_date_pattern_share", sql=V.with_views("localised") + """
SELECT avg(CAST(regexp_matches(lower(fecha), '\\b\\d{1,2}\\b') AS DOUBLE)) AS day_share,
  avg(CAST(regexp_matches(lower(fecha), '\\b(ene|feb|mar|abr|may|jun|jul|ago|sep|sept|oct|nov|dic)\\b') AS DOUBLE)) AS month_share,
  avg(CAST(regexp_matches(lower(fecha), '\\b\\d{4}\\b') AS DOUBLE)) AS year_share FROM localised""")
def prf_21(spark, sf):
    r = P.date_pattern_share(V.localised(V.tables(spark, sf).orders), "fecha")
    return r


@register("prf_22_parse_issue_counts", sql=V.with_views("localised") + f"""
SELECT count(*) FILTER (WHERE {Q.parse_strict('fecha')} IS NULL) AS null_dates,
  count(*) FILTER (WHERE try_cast(replace(replace(monto_total, '.', ''), ',', '.') AS DOUBLE) IS NULL) AS null_targets
FROM localised""")
def prf_22(spark, sf):
    from sparktab.functions import dates as D
    from sparktab.functions import numbers as N
    loc = V.localised(V.tables(spark, sf).orders)
    return loc.agg(F.count_if(D.parse_localised(F.col("fecha"), strict=True).isNull()).alias("null_dates"),
                   F.count_if(N.parse_european(F.col("monto_total")).isNull()).alias("null_targets"))


@register("prf_23_top_values", sql="""
WITH vc AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
            UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
            UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2)
SELECT column_name, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM vc)
WHERE rank <= 5""")
def prf_23(spark, sf):
    o = V.tables(spark, sf).orders
    return P.top_values(o, ["o_orderstatus", "o_orderpriority", "o_custkey"], k=5)


@register("prf_24_trend_slope", sql=V.with_views("daily_series") + """
SELECT series, round(regr_slope(value, datediff('day', d0, d)), 6) AS slope
FROM daily_series JOIN (SELECT series, min(d) AS d0 FROM daily_series GROUP BY series) USING (series)
GROUP BY series""")
def prf_24(spark, sf):
    r = P.trend_slope(V.daily_series(V.tables(spark, sf).orders), "value", "d", ["series"])
    return r.withColumn("slope", F.round("slope", 6))


_SETS = {"sales_daily": ["fecha", "monto_total"], "orders_export": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
         "invoices": ["invoice_key", "factura_nombre", "factura_monto_total", "factura_total_descuentos", "factura_total_pagos", "vendedor_id", "cliente_nombre"]}


def _set_columns(dataset: str, src: str, headerless: bool = False) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, '{f'_c{i}' if headerless else c}' AS column_name, count(*) AS n, count(*) - count({c}) AS missing, "
        f"count(DISTINCT CAST({c} AS VARCHAR)) AS n_unique FROM {src}" for i, c in enumerate(_SETS[dataset]))


@register("prf_03_read_and_profile", sql=L.options_sql(V.with_views("localised", "daily_series", "invoices")) + f"""
, cols AS ({_set_columns('sales_daily', 'localised', True)} UNION ALL {_set_columns('invoices', 'invoices')} UNION ALL {_set_columns('orders_export', 'orders')}
  UNION ALL SELECT 'sales_category', '_c' || CAST(i AS VARCHAR), count(*), 0, count(DISTINCT string_split(value, ';')[i + 1])
            FROM lines, (VALUES (0), (1)) AS t(i) WHERE dataset = 'sales_category' GROUP BY i)
SELECT dataset, 'ok' AS read_status, 'utf-8' AS encoding, separator, decimal, has_header, column_name, n_rows, missing, n_unique,
       CAST(NULL AS VARCHAR) AS error_message FROM cols JOIN options USING (dataset)
UNION ALL SELECT 'documents_latin1', 'ok', CASE WHEN (SELECT bool_or(regexp_matches(text, '[\\x{{80}}-\\x{{FF}}]')) FROM documents) THEN 'latin1' ELSE 'utf-8' END,
       '|', CAST(NULL AS VARCHAR), true, 'doc_id', count(*), count(*) - count(doc_id), count(DISTINCT doc_id), NULL FROM documents
UNION ALL SELECT 'missing_dataset', 'error', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'PATH_NOT_FOUND'""")
def prf_03(spark, sf):
    """Detect the options of all landed sets, read and profile them; a set
    that cannot be read yields an error row.  The documents' separator is
    stated, and of them the id column and no decimal mark are compared."""
    base = L.land(spark, sf)
    r = P.read_and_profile(spark, [f"{base}/{n}" for n in [*L.DATASETS, "missing_dataset"]], {"documents_latin1": "|"})
    docs = F.col("dataset") == "documents_latin1"
    return r.where(~docs | (F.col("column_name") == "doc_id")).withColumn("decimal", F.when(~docs, F.col("decimal")))


@register("prf_01_dataset_profile", sql=V.with_views("wide_customer") + f"""
, p AS ({Q.profile_sql("wide_customer", WIDE_COLS)})
, h AS (SELECT * FROM wide_customer ORDER BY customer_id LIMIT 5)
, v AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, string_agg(coalesce(CAST({c} AS VARCHAR), 'null'), ' | ' ORDER BY customer_id) AS sample_values FROM h" for c, _ in WIDE_COLS)})
SELECT p.*, v.sample_values, {len(WIDE_COLS)} AS n_columns FROM p JOIN v USING (column_name)""")
def prf_01_dataset(spark, sf):
    """The whole profile of a frame whose column names have blanks around
    them: trimmed names, number of columns, five sample rows by key."""
    w = _wide(spark, sf)
    p = P.dataset_profile(w.toDF(*[f" {c} " if i % 2 else c for i, c in enumerate(w.columns)]), ["customer_id"])
    return p.withColumn("sample_values", F.array_join("sample_values", " | ", "null"))


_TEXT_DATES = {"iso": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), "iso_t": ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
               "day_first": ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"), "dotted": ("dd.MM.yyyy", "%d.%m.%Y")}
_FORMAT_COLS = [*_TEXT_DATES, "two_forms", "wrong_day", "event_type", "event_id_text"]


@register("prf_02_date_formats", sql="WITH s AS (SELECT event_id, " + ", ".join(f"strftime(ts, '{d}') AS {c}" for c, (_, d) in _TEXT_DATES.items()) + """,
  CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%Y-%m-%d') END AS two_forms,
  CASE WHEN event_id % 2 = 0 THEN '31/02/2024' ELSE strftime(ts, '%d/%m/%Y') END AS wrong_day, event_type, CAST(event_id AS VARCHAR) AS event_id_text FROM events)
, f AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {Q.signature_format(c)} AS format FROM s" for c in _FORMAT_COLS) + """)
, g AS (SELECT column_name, format, count(*) AS n FROM f GROUP BY ALL)
, r AS (SELECT column_name, coalesce(sum(n) FILTER (WHERE format IS NOT NULL), 0) / sum(n) AS ratio FROM g GROUP BY column_name)
, b AS (SELECT column_name, format FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, format) AS k FROM g WHERE format IS NOT NULL) WHERE k = 1)
, v AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, string_agg(v, ' | ' ORDER BY event_id) AS sample_values FROM (SELECT event_id, {c} AS v FROM s WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 10)"
    for c in _FORMAT_COLS) + """)
SELECT column_name, round(ratio, 3) AS ratio, ratio >= 0.6 AS is_date, format, sample_values FROM r LEFT JOIN b USING (column_name) LEFT JOIN v USING (column_name)""")
def prf_02_formats(spark, sf):
    """Date and date-time texts of the events in several forms: the format
    that their signatures name, the share that parses, ten sample values."""
    e = V.tables(spark, sf).events
    k = F.col("event_id") % 3
    s = e.select("event_id", *[F.date_format("ts", f).alias(c) for c, (f, _) in _TEXT_DATES.items()],
                 F.when(k == 0, F.lit("n/a")).when(k == 1, F.date_format("ts", "dd/MM/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("two_forms"),
                 F.when(F.col("event_id") % 2 == 0, F.lit("31/02/2024")).otherwise(F.date_format("ts", "dd/MM/yyyy")).alias("wrong_day"),
                 "event_type", F.col("event_id").cast("string").alias("event_id_text"))
    r = P.date_formats(s, _FORMAT_COLS, 0.6, ["event_id"])
    return r.withColumn("sample_values", F.array_join("sample_values", " | "))
