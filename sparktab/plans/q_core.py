"""Registered queries: sources and sinks (SRC-*, SNK-*), forecasting (FCT-*),
chart aggregates (VIZ-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktab.functions import dates as D
from sparktab.functions import numbers as N
from sparktab.operators import charts as C
from sparktab.operators import forecast as FC
from sparktab.operators import models as M
from sparktab.operators.features import identifier_features
from sparktab.plans import landing as L
from sparktab.plans import views as V
from sparktab.plans.registry import register
from sparktab.session import checkpoint_path
from sparktab.sources import catalog as CAT
from sparktab.sources import sniff as SN


def _dataset_lines(spark, sf, names=("sales_daily", "sales_category")):
    base = L.land(spark, sf, list(names))
    ln = SN.lines(spark, [f"{base}/{n}" for n in names])
    return ln.withColumn("dataset", F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1))


_LINES_SQL = V.with_views("localised", "daily_series") + ", lines AS (" + L.SQL_LINES["sales_daily"] + \
    " UNION ALL " + L.SQL_LINES["sales_category"] + ")\n"


@register("src_01_text_sample", check="R")
def src_01(spark, sf):
    """First 20 lines within the first 8 KB of every landed file, each file
    in its own encoding; only the heads are read."""
    base = L.land(spark, sf)
    return SN.file_heads(spark, [f"{base}/{name}" for name in L.DATASETS]).select("file", "line_no", "value")


@register("src_01_bounded_heads", sql="""
WITH l AS (SELECT doc_id // 500 AS block, doc_id, concat_ws('|', CAST(doc_id AS VARCHAR), lang,
                  regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E]+', '?', 'g')) AS line FROM documents)
, p AS (SELECT block, line, row_number() OVER w AS line_no,
               coalesce(sum(length(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
        FROM l WINDOW w AS (PARTITION BY block ORDER BY doc_id))
SELECT block, 'utf-8' AS encoding, line_no, substr(line, 1, CAST(8192 - start_at AS BIGINT)) AS value FROM p
WHERE line_no <= 20 AND start_at < 8192""")
def src_01_heads(spark, sf):
    """Heads of files of 500 documents each, their last line cut where the
    8 KB end."""
    r = SN.file_heads(spark, L.land_heads(spark, sf))
    return r.select(F.regexp_extract("file", r"block=(\d+)", 1).cast("bigint").alias("block"), "encoding", "line_no", "value")


@register("src_02_separator_sniffing", sql=_LINES_SQL + """
, m AS (SELECT dataset, avg(len(string_split(value, ','))) AS m0, avg(len(string_split(value, ';'))) AS m1,
               avg(len(string_split(value, chr(9)))) AS m2, avg(len(string_split(value, '|'))) AS m3
        FROM lines WHERE trim(value) <> '' GROUP BY dataset)
SELECT dataset, CASE WHEN m0 >= m1 AND m0 >= m2 AND m0 >= m3 THEN ',' WHEN m1 >= m2 AND m1 >= m3 THEN ';'
                     WHEN m2 >= m3 THEN chr(9) ELSE '|' END AS separator,
  round(m0, 6) AS mean_fields_0, round(m1, 6) AS mean_fields_1, round(m2, 6) AS mean_fields_2, round(m3, 6) AS mean_fields_3
FROM m""")
def src_02(spark, sf):
    """Separator per data set over all its lines (highest mean field count; ties keep the earlier)."""
    return SN.detect_separator(_dataset_lines(spark, sf), ["dataset"])


@register("src_02_separator_first_lines", check="R")
def src_02_first(spark, sf):
    """The reference's rule on the first 10 lines of each file."""
    base = L.land(spark, sf)
    return SN.detect_separator(SN.file_heads(spark, [f"{base}/{n}" for n in L.DATASETS], n=SN.SNIFF_LINES), ["file"])


@register("src_03_decimal_mark", sql=_LINES_SQL + """
SELECT dataset, CAST(sum(len(regexp_extract_all(value, '\\d,\\d'))) AS BIGINT) AS comma_hits,
  CAST(sum(len(regexp_extract_all(value, '\\d\\.\\d'))) AS BIGINT) AS period_hits,
  CASE WHEN sum(len(regexp_extract_all(value, '\\d,\\d'))) > 2 * sum(len(regexp_extract_all(value, '\\d\\.\\d'))) THEN ',' ELSE '.' END AS decimal
FROM lines GROUP BY dataset""")
def src_03(spark, sf):
    return SN.detect_decimal(_dataset_lines(spark, sf), ["dataset"])


@register("src_04_encoding", sql="""
SELECT 'documents_latin1' AS dataset, CASE WHEN bool_or(regexp_matches(text, '[\\x{80}-\\x{FF}]')) THEN 'latin1' ELSE 'utf-8' END AS encoding
FROM documents
UNION ALL SELECT 'sales_daily', 'utf-8' UNION ALL SELECT 'invoices', 'utf-8' UNION ALL SELECT 'orders_export', 'utf-8'""")
def src_04(spark, sf):
    """Encoding per landed data set: utf-8 when every file is valid UTF-8, else latin1."""
    names = ["documents_latin1", "sales_daily", "invoices", "orders_export"]
    base = L.land(spark, sf, names)
    e = SN.detect_encoding(spark, [f"{base}/{n}" for n in names])
    e = e.withColumn("dataset", F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1))
    return e.groupBy("dataset").agg(
        F.when(F.bool_or(F.col("encoding") == "latin1"), F.lit("latin1")).otherwise(F.lit("utf-8")).alias("encoding"))


_UTF8_SETS = ["sales_daily", "sales_category", "invoices", "orders_export"]
_OPTIONS_SQL = L.options_sql(V.with_views("localised", "daily_series", "invoices"))


@register("src_05_detect_and_scan", sql=_OPTIONS_SQL + """
SELECT dataset, separator, decimal, has_header, n_columns, n_rows, n_columns > 1 AS accepted FROM options""")
def src_05(spark, sf):
    """Detect separator, decimal mark and header of all UTF-8 sets in one
    pass, then scan with those options; accepted only with more than one column."""
    base = L.land(spark, sf, _UTF8_SETS)
    parts = []
    for o in SN.detect_options(spark, [f"{base}/{n}" for n in _UTF8_SETS]).collect():  # one row per data set
        df = SN.read_delimited(spark, f"{base}/{o['dataset']}", o["separator"], o["has_header"], o["encoding"])
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            *[F.lit(o[c]).alias(c) for c in ("dataset", "separator", "decimal", "has_header")], F.lit(len(df.columns)).alias("n_columns"), "n_rows",
            F.lit(SN.accepted(df)).alias("accepted")))
    r = parts[0]
    for part in parts[1:]:
        r = r.unionByName(part)
    return r


@register("src_06_headerless_named_read", dates=["d"], sql=V.with_views("daily") + """
SELECT d, value FROM daily""")
def src_06(spark, sf):
    """Headerless ';' file read with assigned names, then localised dates and
    decimal-comma amounts parsed back: equals the daily series."""
    base = L.land(spark, sf, ["sales_daily"])
    raw = SN.read_delimited(spark, f"{base}/sales_daily", ";", False, schema="fecha string, monto_total string")
    return raw.select(D.parse_localised(F.col("fecha")).alias("d"), N.parse_european(F.col("monto_total")).alias("value"))


@register("src_07_header_detection", sql=_OPTIONS_SQL + "SELECT dataset, has_header FROM options")
def src_07(spark, sf):
    """Header present unless the first line holds a month token or a decimal comma."""
    base = L.land(spark, sf, _UTF8_SETS)
    return SN.detect_options(spark, [f"{base}/{n}" for n in _UTF8_SETS]).select("dataset", "has_header")


@register("src_08_relational_source", sql="""
SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus""")
def src_08(spark, sf):
    """Relational source through the catalog stand-in (JDBC needs a database
    server, which is not started here); the JDBC path is ``catalog.read_relational``."""
    CAT.register_tables(spark, sf, ["orders"])
    df = CAT.read_relational(spark, {"type": "catalog", "query": "SELECT o_orderstatus FROM orders"})
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


_TABLES_SQL = ", ".join(f"'{t}'" for t in CAT.TABLES)


@register("src_09_list_tables", sql=f"""
SELECT DISTINCT table_name FROM information_schema.tables WHERE table_name IN ({_TABLES_SQL})""")
def src_09(spark, sf):
    CAT.register_tables(spark, sf)
    return CAT.list_tables(spark, set(CAT.TABLES))


@register("src_10_table_schema", sql="""
SELECT table_name, column_name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                 WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS data_type,
  CAST(ordinal_position - 1 AS BIGINT) AS position
FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem', 'embeddings')""")
def src_10(spark, sf):
    CAT.register_tables(spark, sf, ["orders", "lineitem", "embeddings"])
    return CAT.describe_tables(spark, "orders, lineitem, embeddings")


@register("src_11_future_dates_file", sql=V.with_views("daily") + """
SELECT fmt, count(*) AS n, min(d) AS first_date, max(d) AS last_date FROM (
  SELECT 'json' AS fmt, CAST(unnest(generate_series((SELECT max(d) FROM daily) + 1, (SELECT max(d) FROM daily) + 30, INTERVAL 1 DAY)) AS DATE) AS d
  UNION ALL
  SELECT 'csv', CAST(unnest(generate_series((SELECT max(d) FROM daily) + 1, (SELECT max(d) FROM daily) + 30, INTERVAL 1 DAY)) AS DATE))
GROUP BY fmt""", dates=["first_date", "last_date"])
def src_11(spark, sf):
    """Future dates written as JSON and CSV, read back by the file suffix."""
    sp = FC.spine(V.daily(V.tables(spark, sf).orders), "d", [], 30, "D").select(F.date_format("d", "yyyy-MM-dd").alias("d"))
    base = checkpoint_path(spark, "future")
    sp.write.mode("overwrite").json(f"{base}/dates.json")
    sp.write.mode("overwrite").option("header", True).csv(f"{base}/dates.csv")
    a = SN.read_future_dates(spark, f"{base}/dates.json").select(F.lit("json").alias("fmt"), F.to_date("d").alias("d"))
    b = SN.read_future_dates(spark, f"{base}/dates.csv").select(F.lit("csv").alias("fmt"), F.to_date("d").alias("d"))
    return a.unionByName(b).groupBy("fmt").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_date"),
                                               F.max("d").alias("last_date"))


# ------------------------------------------------------------------ sinks
@register("snk_01_csv_sink_roundtrip", sql=V.with_views("daily") + """
SELECT count(*) AS n_rows, round(sum(value), 2) AS total FROM daily""")
def snk_01(spark, sf):
    """CSV with a header and no index column, read back."""
    from sparktab.sources.io import write_csv
    d = V.daily(V.tables(spark, sf).orders)
    path = checkpoint_path(spark, "csv-sink")
    write_csv(d, path)
    back = spark.read.option("header", True).schema("d date, value double").csv(path)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))


@register("snk_02_materialise_dataset", sql=V.with_views("invoices") + """
SELECT count(*) AS row_count, 7 AS column_count, true AS has_size FROM invoices""")
def snk_02(spark, sf):
    """A query materialised as a named data set with its metadata row."""
    from sparktab.sources.datasets import materialise
    t = V.tables(spark, sf)
    meta = materialise(spark, V.invoices(t.lineitem, t.orders, t.customer), "invoices")
    return meta.select("row_count", "column_count", (F.col("file_size_mb") > 0).alias("has_size"))


@register("snk_03_dataset_listing", dates=["created_at"], sql=V.with_views("query_log") + """
SELECT q_id AS id, 'dataset_' || CAST(q_id AS VARCHAR) AS name, o_orderdate AS created_at,
  coalesce(CASE q_id % 3 WHEN 1 THEN 'agent' WHEN 2 THEN 'manual' END, 'manual') AS generation_type
FROM query_log JOIN orders ON q_id = o_orderkey ORDER BY created_at DESC, id DESC""")
def snk_03(spark, sf):
    """Dataset metadata listing, newest first; a missing generation type reads 'manual'."""
    from sparktab.sources.datasets import listing
    t = V.tables(spark, sf)
    meta = V.query_log(t.orders).join(t.orders, F.col("q_id") == F.col("o_orderkey")).select(
        F.col("q_id").alias("id"), F.concat(F.lit("dataset_"), F.col("q_id").cast("string")).alias("name"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.pmod("q_id", F.lit(3)) == 1, F.lit("agent")).when(F.pmod("q_id", F.lit(3)) == 2, F.lit("manual"))
        .alias("generation_type"))
    return listing(meta)


@register("snk_04_dataset_preview", sql="""
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 100""")
def snk_04(spark, sf):
    """First `limit` rows (<= 0 means all), NaN as null, plus the total row count."""
    from sparktab.sources.datasets import preview
    o = V.tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return preview(o, "o_orderkey", 100)


@register("snk_05_replace_in_place", sql=V.with_views("daily") + """
SELECT d, round(value * 1.21, 4) AS value, count(*) OVER () AS row_count FROM daily""", dates=["d"])
def snk_05(spark, sf):
    """Replace a data set by its edited rows: a new version folder, then the metadata switches; the new version is read back."""
    from sparktab.sources.datasets import materialise, replace
    d = V.daily(V.tables(spark, sf).orders)
    meta = materialise(spark, d, "daily")
    new = replace(spark, meta, d.withColumn("value", F.col("value") * 1.21)).first()
    back = spark.read.parquet(new["path"])
    return back.select("d", F.round("value", 4).alias("value"), F.lit(new["row_count"]).cast("bigint").alias("row_count"))


@register("snk_06_predictions_sink", dates=["d"], sql=V.with_views("daily") + """
, tail AS (SELECT *, row_number() OVER (ORDER BY d DESC) AS r FROM daily)
, c AS (SELECT count(*) FILTER (WHERE r <= 30) AS n, avg(value) FILTER (WHERE r <= 7) AS m7,
               avg(value) FILTER (WHERE r <= 30) AS m30 FROM tail)
, spine AS (SELECT CAST(unnest(generate_series(max(d) + 1, max(d) + 30, INTERVAL 1 DAY)) AS DATE) AS d FROM daily)
SELECT d, round(CASE WHEN n >= 7 THEN m7 ELSE m30 END, 4) AS prediction FROM spine, c""")
def snk_06(spark, sf):
    """predictions keyed by date written beside (never over) the history, read back."""
    h = V.daily(V.tables(spark, sf).orders)
    f = FC.frozen_forecast(h)
    path = checkpoint_path(spark, "predictions")
    f.select("d", "prediction").write.mode("overwrite").option("header", True).csv(f"{path}/predictions.csv")
    back = spark.read.option("header", True).schema("d date, prediction double").csv(f"{path}/predictions.csv")
    return back.withColumn("prediction", F.round("prediction", 4))


@register("snk_07_artefact_check", check="R")
def snk_07(spark, sf):
    h = V.daily(V.tables(spark, sf).orders)
    path = checkpoint_path(spark, "artefacts")
    FC.frozen_forecast(h).select("d", "prediction").write.mode("overwrite").option("header", True) \
        .csv(f"{path}/predictions.csv")
    return SN.artefact_check(spark, path, ["predictions.csv", "forecast_plot.png"])


# ------------------------------------------------------------------ forecasting
_CARRY_SQL = V.with_views("daily_series") + """
, tail AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS r FROM daily_series)
, c AS (SELECT series, count(*) FILTER (WHERE r <= 30) AS n, arg_max(value, d) AS lag_1,
               avg(value) FILTER (WHERE r <= 7) AS m7, avg(value) FILTER (WHERE r <= 30) AS m30 FROM tail GROUP BY series)
, carried AS (SELECT series, lag_1, CASE WHEN n >= 30 THEN m7 ELSE m30 END AS lag_7, m30 AS lag_30,
                     CASE WHEN n >= 7 THEN m7 ELSE m30 END AS rolling_mean_7, m30 AS rolling_mean_30 FROM c)
, spine AS (SELECT series, CAST(unnest(generate_series(max(d) + 1, max(d) + 30, INTERVAL 1 DAY)) AS DATE) AS d FROM daily_series GROUP BY series)
, fc AS (SELECT s.series, s.d, c.lag_1, c.lag_7, c.lag_30, c.rolling_mean_7, c.rolling_mean_30, c.rolling_mean_7 AS prediction
         FROM spine s JOIN carried c USING (series))
"""


def _series(spark, sf):
    return V.daily_series(V.tables(spark, sf).orders)


@register("fct_01_future_spine_daily", dates=["d"], sql=V.with_views("daily_series") + """
SELECT series, CAST(unnest(generate_series(max(d) + 1, max(d) + 30, INTERVAL 1 DAY)) AS DATE) AS d FROM daily_series GROUP BY series""")
def fct_01(spark, sf):
    return FC.spine(_series(spark, sf), "d", ["series"], 30, "D").select("series", "d")


@register("fct_01_future_spine_weekly", dates=["d"], sql=V.with_views("daily_series") + """
, l AS (SELECT series, max(d) + 7 AS s FROM daily_series GROUP BY series)
, m AS (SELECT series, s + CAST((8 - isodow(s)) % 7 AS INTEGER) AS first_monday FROM l)
SELECT series, CAST(first_monday + INTERVAL (7 * i) DAY AS DATE) AS d FROM m, range(0, 30) t(i)""")
def fct_01_w(spark, sf):
    return FC.spine(_series(spark, sf), "d", ["series"], 30, "W").select("series", "d")


@register("fct_01_future_spine_monthly", dates=["d"], sql=V.with_views("daily_series") + """
, l AS (SELECT series, max(d) AS last FROM daily_series GROUP BY series)
SELECT series, last_day(CAST(date_trunc('month', last) + INTERVAL (i + 1) MONTH AS DATE)) AS d FROM l, range(0, 30) t(i)""")
def fct_01_m(spark, sf):
    return FC.spine(_series(spark, sf), "d", ["series"], 30, "M").select("series", "d")


@register("fct_02_04_carried_history", sql=_CARRY_SQL + """
SELECT series, lag_1, round(lag_7, 4) AS lag_7, round(lag_30, 4) AS lag_30, round(rolling_mean_7, 4) AS rolling_mean_7,
  round(rolling_mean_30, 4) AS rolling_mean_30 FROM carried""")
def fct_04(spark, sf):
    c = FC.carried_history(_series(spark, sf), "value", "d", ["series"])
    return c.select("series", "lag_1", *[F.round(x, 4).alias(x) for x in ("lag_7", "lag_30", "rolling_mean_7", "rolling_mean_30")])


@register("fct_05_history_and_forecast", dates=["d"], sql=_CARRY_SQL + """
SELECT series, d, value AS actual, value AS prediction, 'historical' AS type FROM daily_series
UNION ALL SELECT series, d, NULL, round(prediction, 4), 'prediction' FROM fc""")
def fct_05(spark, sf):
    h = _series(spark, sf)
    f = FC.frozen_forecast(h, part=["series"]).withColumn("prediction", F.round("prediction", 4))
    return FC.with_history(h, f, part=["series"])


@register("fct_06_07_bands", dates=["d"], sql=_CARRY_SQL + """
, sd AS (SELECT series, stddev_samp(value) AS s FROM daily_series GROUP BY series)
, res AS (SELECT series, value - avg(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS residual FROM daily_series)
, rsd AS (SELECT series, stddev_samp(residual) AS rs FROM res GROUP BY series)
SELECT fc.series, fc.d, round(prediction, 4) AS prediction, round(prediction - s, 4) AS lower, round(prediction + s, 4) AS upper,
  round(prediction - 1.96 * rs, 4) AS lower_95, round(prediction + 1.96 * rs, 4) AS upper_95
FROM fc JOIN sd USING (series) JOIN rsd USING (series)""")
def fct_06(spark, sf):
    h = _series(spark, sf)
    f = FC.frozen_forecast(h, part=["series"])
    b = FC.band(f, h, part=["series"])
    # the forecast carries the mean of the last 7 values: its residuals one step ahead (daily grain)
    w = Window.partitionBy("series").orderBy("d").rowsBetween(-7, -1)
    res = h.withColumn("residual", F.col("value") - F.avg("value").over(w))
    b = FC.band(b, res, "residual", part=["series"], z=1.96, lower="lower_95", upper="upper_95")
    return b.select("series", "d", *[F.round(c, 4).alias(c) for c in ("prediction", "lower", "upper", "lower_95", "upper_95")])


@register("fct_08_change_pct", sql=_CARRY_SQL + """
SELECT series, arg_max(value, d) AS last_actual, round((SELECT arg_min(prediction, d) FROM fc WHERE fc.series = ds.series), 4) AS first_forecast,
  round(((SELECT arg_min(prediction, d) FROM fc WHERE fc.series = ds.series) - arg_max(value, d)) / arg_max(value, d) * 100, 4) AS change_pct
FROM daily_series ds GROUP BY series""")
def fct_08(spark, sf):
    h = _series(spark, sf)
    f = FC.frozen_forecast(h, part=["series"])
    r = FC.change_pct(h, f, part=["series"])
    return r.select("series", "last_actual", F.round("first_forecast", 4).alias("first_forecast"),
                    F.round("change_pct", 4).alias("change_pct"))


@register("fct_09_11_score_summary", dates=["first_date", "last_date"], sql=_CARRY_SQL + """
SELECT 'frozen_rolling_mean_7' AS model, 'lag_1,lag_7,lag_30,rolling_mean_7,rolling_mean_30' AS features,
  count(*) AS rows, min(d) AS first_date, max(d) AS last_date, round(min(prediction), 4) AS min, round(max(prediction), 4) AS max,
  round(avg(prediction), 4) AS mean, round(stddev_samp(prediction), 4) AS std FROM fc""")
def fct_09(spark, sf):
    h = _series(spark, sf)
    f = FC.frozen_forecast(h, part=["series"])
    feats = ["lag_1", "lag_7", "lag_30", "rolling_mean_7", "rolling_mean_30"]
    r = FC.run_summary(f, "d", "frozen_rolling_mean_7", feats)
    from sparktab.operators.sequence import one_row
    s = one_row(FC.score_summary(f))
    return r.select("*", *[F.round(s[c], 4).alias(c) for c in ("min", "max", "mean", "std")])


# ------------------------------------------------------------------ charts
_ANOM_SQL = """WITH q AS (SELECT quantile_cont(l_discount, 0.05) AS threshold FROM lineitem)
, f AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount,
               CAST(l_discount <= threshold AS INTEGER) AS is_anomaly FROM lineitem, q)
"""


def _flagged(spark, sf):
    li = V.tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount")
    return M.anomaly_flag(li, "l_discount", 0.05).drop("threshold")


@register("viz_01_score_histogram", sql=_ANOM_SQL + """
, r AS (SELECT is_anomaly, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM f GROUP BY is_anomaly)
, b AS (SELECT f.is_anomaly, CASE WHEN mx = mn THEN 25 ELSE least(floor((l_extendedprice - mn) / (mx - mn) * 50), 49) END AS bin, mn, mx
        FROM f JOIN r USING (is_anomaly))
SELECT is_anomaly, CAST(bin AS BIGINT) AS bin, count(*) AS n, round(mn + (mx - mn) * bin / 50, 4) AS bin_start,
  round(mn + (mx - mn) * (bin + 1) / 50, 4) AS bin_end FROM b GROUP BY is_anomaly, bin, mn, mx""")
def viz_01(spark, sf):
    h = C.histogram(_flagged(spark, sf), "l_extendedprice", ["is_anomaly"])
    return h.withColumn("bin_start", F.round("bin_start", 4)).withColumn("bin_end", F.round("bin_end", 4))


@register("viz_02_top_rows", sql="""
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey DESC) AS display_order FROM (
  SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)""")
def viz_02(spark, sf):
    o = V.tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return C.top_rows(o, "o_totalprice", "o_orderkey", 10)


@register("viz_03_rate_by_prefix", sql=V.with_views("invoices") + """
, f AS (SELECT CASE WHEN factura_nombre IS NULL OR factura_nombre = '/' OR split_part(factura_nombre, '/', 1) = '' THEN 'UNKNOWN'
                    ELSE split_part(factura_nombre, '/', 1) || '/' || split_part(factura_nombre, '/', 2) END AS prefix,
               CAST(factura_total_pagos = 0 AS INTEGER) AS flag FROM invoices)
SELECT prefix, count(*) AS count, round(avg(flag), 3) AS rate FROM f GROUP BY prefix ORDER BY count DESC, prefix LIMIT 10""")
def viz_03(spark, sf):
    """Flag rate by invoice prefix (series and year), the ten largest groups."""
    t = V.tables(spark, sf)
    inv = identifier_features(V.invoices(t.lineitem, t.orders, t.customer), "factura_nombre")
    p = F.when(F.col("factura_nombre_prefix") == "UNKNOWN", F.lit("UNKNOWN")).otherwise(
        F.concat_ws("/", F.split("factura_nombre", "/").getItem(0), F.split("factura_nombre", "/").getItem(1)))
    f = inv.select(p.alias("prefix"), (F.col("factura_total_pagos") == 0).cast("int").alias("flag"))
    return C.rate_by_group(f, "prefix", "flag", 10)


@register("viz_04_means_by_flag", sql=_ANOM_SQL + """
SELECT is_anomaly, round(avg(l_extendedprice), 3) AS mean_l_extendedprice, round(avg(l_quantity), 3) AS mean_l_quantity
FROM f GROUP BY is_anomaly""")
def viz_04(spark, sf):
    return C.means_by_flag(_flagged(spark, sf), "is_anomaly", ["l_extendedprice", "l_quantity"])


@register("viz_05_history_forecast_series", dates=["d", "split_date"], sql=_CARRY_SQL + """
, u AS (SELECT series, d, value AS actual, value AS prediction, 'historical' AS type FROM daily_series
        UNION ALL SELECT series, d, NULL, round(prediction, 4), 'prediction' FROM fc)
SELECT u.*, m.split_date FROM u JOIN (SELECT series, max(d) AS split_date FROM daily_series GROUP BY series) m USING (series)
WHERE u.prediction IS NOT NULL""")
def viz_05(spark, sf):
    h = _series(spark, sf)
    f = FC.frozen_forecast(h, part=["series"]).withColumn("prediction", F.round("prediction", 4))
    u = FC.with_history(h, f, part=["series"]).where(F.col("prediction").isNotNull())
    split = h.groupBy("series").agg(F.max("d").alias("split_date"))
    return u.join(split, "series")


@register("viz_06_residuals", dates=["d"], sql=V.with_views("daily_series") + """
SELECT series, d, value - lag(value, 7) OVER (PARTITION BY series ORDER BY d) AS residual FROM daily_series""")
def viz_06(spark, sf):
    from pyspark.sql import Window
    h = _series(spark, sf)
    s = h.withColumn("yhat", F.lag("value", 7).over(Window.partitionBy("series").orderBy("d")))
    return C.residuals(s, "value", "yhat", ["series", "d"])
