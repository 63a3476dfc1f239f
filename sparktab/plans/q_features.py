"""Registered queries: features (FEA-*) and splits (SPL-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.operators import features as fe
from sparktab.operators import split as sp
from sparktab.plans import views as V
from sparktab.plans.registry import register

_CAL_SQL = """year(d) AS d__year, month(d) AS d__month, day(d) AS d__day, isodow(d) - 1 AS d__dayofweek,
  CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS d__is_weekend,
  CASE WHEN day(d) = 1 THEN 1 ELSE 0 END AS d__is_month_start,
  CASE WHEN d = last_day(d) THEN 1 ELSE 0 END AS d__is_month_end,
  quarter(d) AS d__quarter, dayofyear(d) AS d__dayofyear, weekofyear(d) AS d__weekofyear"""


@register("fea_flagship_daily_features", dates=["d"], sql=V.with_views("daily_series") + f"""
SELECT series, d, value, {_CAL_SQL},
  lag(value, 1) OVER w AS value_lag1,
  lag(value, 7) OVER w AS value_lag7,
  CASE WHEN count(value) OVER w7 >= 7 THEN round(avg(value) OVER w7, 4) END AS value_roll7_mean,
  CASE WHEN row_number() OVER w <= floor(count(*) OVER (PARTITION BY series) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM daily_series
WINDOW w AS (PARTITION BY series ORDER BY d),
       w7 AS (PARTITION BY series ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def flagship(spark, sf):
    """orders -> daily revenue per priority -> FEA-01/02/03/05 -> SPL-02."""
    t = V.tables(spark, sf)
    s = V.daily_series(t.orders)
    s = fe.calendar_features(s, "d")
    s = fe.add_lags(s, "value", ["d"], ["series"], lags=(1, 7))
    s = fe.rolling(s, "value", ["d"], ["series"], k=7)
    s = s.withColumn("value_roll7_mean", F.round("value_roll7_mean", 4))
    return sp.temporal_split(s, "d", ["series"])


def _daily(spark, sf):
    return V.daily_series(V.tables(spark, sf).orders)


_W = "WINDOW w AS (PARTITION BY series ORDER BY d)"


def _r4(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


@register("fea_01_calendar_features", dates=["d"], sql=V.with_views("daily") + """
SELECT d, year(d) AS d__year, month(d) AS d__month, day(d) AS d__day, isodow(d) - 1 AS d__dayofweek,
  CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS d__is_weekend,
  CASE WHEN day(d) = 1 THEN 1 ELSE 0 END AS d__is_month_start,
  CASE WHEN d = last_day(d) THEN 1 ELSE 0 END AS d__is_month_end
FROM daily""")
def fea_01(spark, sf):
    return fe.calendar_features(V.daily(V.tables(spark, sf).orders).select("d"), "d", extended=False)


@register("fea_02_calendar_extended", dates=["d"], sql=V.with_views("daily") + """
SELECT d, quarter(d) AS d__quarter, dayofyear(d) AS d__dayofyear, weekofyear(d) AS d__weekofyear
FROM daily""")
def fea_02(spark, sf):
    s = fe.calendar_features(V.daily(V.tables(spark, sf).orders).select("d"), "d", extended=True)
    return s.select("d", "d__quarter", "d__dayofyear", "d__weekofyear")


@register("fea_03_calendar_lags", dates=["d"], sql=V.with_views("daily_series") + """
, sparse AS (SELECT series, d, value FROM daily_series WHERE (day(d) * 7 + month(d)) % 5 <> 0)
, spine AS (SELECT series, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM sparse GROUP BY series)
SELECT s.series, s.d, x.value, x.d IS NOT NULL AS has_row, a.value AS value_day_lag1, b.value AS value_day_lag7, c.value AS value_day_lag30
FROM spine s LEFT JOIN sparse x ON x.series = s.series AND x.d = s.d LEFT JOIN sparse a ON a.series = s.series AND a.d = s.d - 1
  LEFT JOIN sparse b ON b.series = s.series AND b.d = s.d - 7 LEFT JOIN sparse c ON c.series = s.series AND c.d = s.d - 30""")
def fea_03_calendar(spark, sf):
    """Lags by date where days are missing: the row lag would take another day's value."""
    sparse = _daily(spark, sf).where((F.dayofmonth("d") * 7 + F.month("d")) % 5 != 0).select("series", "d", "value")
    return fe.calendar_lags(sparse, "value", "d", ["series"])


@register("fea_03_row_lags", dates=["d"], sql=V.with_views("daily_series") + f"""
SELECT series, d, value, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2,
  lag(value, 3) OVER w AS value_lag3, lag(value, 7) OVER w AS value_lag7, lag(value, 30) OVER w AS value_lag30
FROM daily_series {_W}""")
def fea_03(spark, sf):
    return fe.add_lags(_daily(spark, sf), "value", ["d"], ["series"])


@register("fea_04_lags_mean_filled", dates=["d"], sql=V.with_views("daily_series") + f"""
SELECT series, d, round(coalesce(lag(value, 1) OVER w, avg(value) OVER (PARTITION BY series)), 4) AS value_lag1,
  round(coalesce(lag(value, 7) OVER w, avg(value) OVER (PARTITION BY series)), 4) AS value_lag7
FROM daily_series {_W}""")
def fea_04(spark, sf):
    s = fe.add_lags(_daily(spark, sf), "value", ["d"], ["series"], lags=(1, 7), fill_mean=True)
    return _r4(s.select("series", "d", "value_lag1", "value_lag7"), "value_lag1", "value_lag7")


@register("fea_05_rolling_mean_full", dates=["d"], sql=V.with_views("daily_series") + """
SELECT series, d,
  CASE WHEN count(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) >= 7
       THEN round(avg(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) END AS value_roll7_mean,
  CASE WHEN count(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) >= 30
       THEN round(avg(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) END AS value_roll30_mean,
  CASE WHEN count(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) >= 7
       THEN round(avg(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) END AS value_prev7_mean
FROM daily_series""")
def fea_05(spark, sf):
    s = _daily(spark, sf)
    s = fe.rolling(s, "value", ["d"], ["series"], k=7)
    s = fe.rolling(s, "value", ["d"], ["series"], k=30)
    s = fe.rolling(s, "value", ["d"], ["series"], k=7, exclude_current=True, out="value_prev7_mean")
    return _r4(s.select("series", "d", "value_roll7_mean", "value_roll30_mean", "value_prev7_mean"),
               "value_roll7_mean", "value_roll30_mean", "value_prev7_mean")


@register("fea_06_rolling_mean_partial", dates=["d"], sql=V.with_views("daily_series") + """
SELECT series, d, round(avg(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS value_roll7_mean
FROM daily_series""")
def fea_06(spark, sf):
    s = fe.rolling(_daily(spark, sf), "value", ["d"], ["series"], k=7, full=False)
    return _r4(s.select("series", "d", "value_roll7_mean"), "value_roll7_mean")


@register("fea_07_rolling_std", dates=["d"], sql=V.with_views("daily_series") + """
SELECT series, d,
  CASE WHEN count(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) >= 7
       THEN round(stddev_samp(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) END AS value_roll7_std,
  CASE WHEN count(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) >= 30
       THEN round(stddev_samp(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 2) END AS value_roll30_std
FROM daily_series""")
def fea_07(spark, sf):
    s = _daily(spark, sf)
    s = fe.rolling(s, "value", ["d"], ["series"], k=7, stat="std")
    s = fe.rolling(s, "value", ["d"], ["series"], k=30, stat="std")
    return s.select("series", "d", F.round("value_roll7_std", 2).alias("value_roll7_std"),
                    F.round("value_roll30_std", 2).alias("value_roll30_std"))


@register("fea_08_moving_averages", dates=["d"], sql=V.with_views("daily_series") + """
SELECT series, d,
  CASE WHEN count(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5
       THEN round(avg(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) END AS ma5,
  CASE WHEN count(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20
       THEN round(avg(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) END AS ma20
FROM daily_series""")
def fea_08(spark, sf):
    s = _daily(spark, sf)
    s = fe.rolling(s, "value", ["d"], ["series"], k=5, out="ma5")
    s = fe.rolling(s, "value", ["d"], ["series"], k=20, out="ma20")
    return _r4(s.select("series", "d", "ma5", "ma20"), "ma5", "ma20")


@register("fea_09_rsi14", dates=["d"], sql=V.with_views("daily_series") + """
, dl AS (SELECT series, d, value - lag(value) OVER (PARTITION BY series ORDER BY d) AS delta FROM daily_series)
, g AS (SELECT series, d,
    count(delta) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS n,
    avg(greatest(delta, 0.0)) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS gain,
    avg(greatest(-delta, 0.0)) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS loss
  FROM dl)
SELECT series, d, CASE WHEN n = 14 THEN round(CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END, 4) END AS rsi
FROM g""")
def fea_09(spark, sf):
    s = fe.rsi(_daily(spark, sf), "value", ["d"], ["series"])
    return _r4(s.select("series", "d", "rsi"), "rsi")


@register("fea_10_deviation_flag", dates=["d"], sql=V.with_views("daily_series") + """
SELECT series, d, CAST(abs(value - avg(value) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        > 2 * stddev_samp(value) OVER (PARTITION BY series) AS INTEGER) AS is_deviation
FROM daily_series""")
def fea_10(spark, sf):
    return fe.deviation_flag(_daily(spark, sf), "value", ["d"], ["series"]).select("series", "d", "is_deviation")


@register("fea_11_ratio_to_group_mean", sql="""
SELECT p_partkey, p_type, round(p_retailprice / avg(p_retailprice) OVER (PARTITION BY p_type), 6) AS price_ratio
FROM part""")
def fea_11(spark, sf):
    p = V.tables(spark, sf).part.select("p_partkey", "p_type", "p_retailprice")
    r = fe.ratio_to_group_mean(p, "p_retailprice", ["p_type"], out="price_ratio")
    return r.select("p_partkey", "p_type", F.round("price_ratio", 6).alias("price_ratio"))


@register("fea_12_high_season", dates=["d"], sql=V.with_views("daily") + """
SELECT d, CASE WHEN month(d) IN (11, 12) THEN 1 ELSE 0 END AS is_high_season FROM daily""")
def fea_12(spark, sf):
    return V.daily(V.tables(spark, sf).orders).select("d", fe.high_season(F.col("d")).alias("is_high_season"))


@register("fea_13_identifier_features", sql=V.with_views("invoices") + """
SELECT invoice_key,
  CASE WHEN factura_nombre IS NULL OR factura_nombre = '/' OR split_part(factura_nombre, '/', 1) = '' THEN 'UNKNOWN'
       ELSE split_part(factura_nombre, '/', 1) END AS factura_nombre_prefix,
  coalesce(CAST(regexp_matches(factura_nombre, '/[0-9]{4}/') AS INTEGER), 0) AS factura_nombre_has_year,
  coalesce(length(factura_nombre), 0) AS factura_nombre_length
FROM invoices""")
def fea_13(spark, sf):
    t = V.tables(spark, sf)
    inv = V.invoices(t.lineitem, t.orders, t.customer).select("invoice_key", "factura_nombre")
    return fe.identifier_features(inv, "factura_nombre").drop("factura_nombre")


@register("fea_14_payment_features", sql=V.with_views("invoices") + """
SELECT invoice_key,
  round(CASE WHEN factura_monto_total > 0 THEN factura_total_pagos / factura_monto_total ELSE 0.0 END, 6) AS payment_ratio,
  CAST(factura_total_pagos = 2 * factura_monto_total AND factura_monto_total > 0 AS INTEGER) AS is_double_payment,
  CAST(factura_total_pagos = 0 AS INTEGER) AS is_zero_payment
FROM invoices""")
def fea_14(spark, sf):
    t = V.tables(spark, sf)
    inv = V.invoices(t.lineitem, t.orders, t.customer)
    r = fe.payment_features(inv, "factura_monto_total", "factura_total_pagos")
    return r.select("invoice_key", F.round("payment_ratio", 6).alias("payment_ratio"), "is_double_payment", "is_zero_payment")


@register("fea_18_class_balance", sql="""
WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality)
SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS class_weight,
  (SELECT min(n) FROM c) / (SELECT max(n) FROM c) < 0.1 AS needs_balancing
FROM c""")
def fea_18(spark, sf):
    from sparktab.operators.models import class_balance
    return class_balance(V.tables(spark, sf).labels, "quality")


@register("fea_19_zscore_scaling", sql="""
SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal_z
FROM customer""")
def fea_19(spark, sf):
    c = V.tables(spark, sf).customer.select("c_custkey", "c_acctbal")
    return fe.zscore(c, ["c_acctbal"]).select("c_custkey", F.round("c_acctbal_z", 6).alias("c_acctbal_z"))


@register("fea_21_interactions", sql="""
SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount
FROM lineitem""")
def fea_21(spark, sf):
    li = V.tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    r = fe.interactions(li, [("l_quantity", "l_discount")])
    return r.select("l_orderkey", "l_linenumber", F.round("l_quantity_x_l_discount", 6).alias("l_quantity_x_l_discount"))


@register("fea_22_value_terciles", dates=["d"], sql=V.with_views("daily") + """
, c AS (SELECT quantile_cont(value, 1/3) AS p1, quantile_cont(value, 2/3) AS p2 FROM daily)
SELECT d, CASE WHEN value <= p1 THEN 'low' WHEN value <= p2 THEN 'medium' ELSE 'high' END AS segment
FROM daily, c""")
def fea_22(spark, sf):
    return fe.terciles(V.daily(V.tables(spark, sf).orders), "value").select("d", "segment")


# ----------------------------------------------------------------- splits
@register("spl_01_hash_split", sql="""
SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 100 < 70 THEN 'train'
  WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 100 < 85 THEN 'valid' ELSE 'test' END AS split
FROM orders""")
def spl_01(spark, sf):
    o = V.tables(spark, sf).orders.select("o_orderkey")
    return sp.random_split(o, "o_orderkey", method="md5")


@register("spl_02_temporal_split", dates=["d"], sql=V.with_views("daily_series") + """
SELECT series, d, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY d) <= floor(count(*) OVER (PARTITION BY series) * 0.8)
  THEN 'train' ELSE 'test' END AS split
FROM daily_series""")
def spl_02(spark, sf):
    return sp.temporal_split(_daily(spark, sf), "d", ["series"]).select("series", "d", "split")


@register("spl_02_split_counts", sql=V.with_views("daily") + """
SELECT split, count(*) AS n FROM (
  SELECT CASE WHEN row_number() OVER (ORDER BY d) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
  FROM daily) GROUP BY split""")
def spl_02_counts(spark, sf):
    s = sp.temporal_split(V.daily(V.tables(spark, sf).orders), "d")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("spl_03_fixed_size_sample", sql="""
SELECT o_orderkey FROM orders ORDER BY CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8) AS BIGINT), o_orderkey LIMIT 1000""")
def spl_03(spark, sf):
    o = V.tables(spark, sf).orders.select("o_orderkey")
    return sp.sample_fixed(o, "o_orderkey", 1000, method="md5")


@register("spl_04_small_data_rule", sql=V.with_views("daily_series") + """
, s AS (SELECT series || '/' || strftime(d, '%Y-%m') AS grp, d FROM daily_series)
SELECT split, count(*) AS n, count(DISTINCT grp) AS groups FROM (
  SELECT grp, CASE WHEN count(*) OVER (PARTITION BY grp) < 100 THEN 'train'
    WHEN row_number() OVER (PARTITION BY grp ORDER BY d) <= floor(count(*) OVER (PARTITION BY grp) * 0.8) THEN 'train'
    ELSE 'test' END AS split FROM s) GROUP BY split""")
def spl_04(spark, sf):
    """Temporal split per (series, month) over the whole table: every group has
    fewer than 100 rows, so the small-data rule puts all of them in train."""
    s = _daily(spark, sf).select(F.concat_ws("/", "series", F.date_format("d", "yyyy-MM")).alias("grp"), "d")
    s = sp.temporal_split(s, "d", ["grp"], small_data_rows=100)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("groups"))


@register("spl_05_kfold_modulo", dates=["d"], sql=V.with_views("daily") + """
SELECT d, (row_number() OVER (ORDER BY d) - 1) % 3 AS fold FROM daily""")
def spl_05(spark, sf):
    return sp.kfold(V.daily(V.tables(spark, sf).orders).select("d"), "d", k=3, mode="modulo", order="d")


@register("spl_05_kfold_random_sizes", sql="""
SELECT CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 5 AS fold, count(*) AS n FROM orders GROUP BY 1""")
def spl_05_random(spark, sf):
    o = V.tables(spark, sf).orders.select("o_orderkey")
    return sp.kfold(o, "o_orderkey", k=5, method="md5").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
