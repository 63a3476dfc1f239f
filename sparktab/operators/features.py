"""Feature engineering (FEA-*): calendar parts, row lags, rolling statistics,
ratios and flags, all as native column expressions and windows.

Windows are partitioned by a series key and run on the daily grain
(one row per series and day), whose size is bounded by the calendar, not by
the volume of the raw table: aggregate first (``views.daily_series``), then
window.  Row lags are *row* lags (lag 7 = seven rows earlier, even across
missing days), as in the reference; ``calendar=True`` would go through a gap-filled
spine (``profile.missing_dates``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.operators.quantiles import exact_quantiles
from sparktab.operators.sequence import one_row


def _w(part, order):
    w = Window.orderBy(*order) if not part else Window.partitionBy(*part).orderBy(*order)
    return w


def calendar_features(df: DataFrame, col: str, extended: bool = True) -> DataFrame:
    """FEA-01/02: `{col}__year` ... ; dayofweek with Monday = 0; flags as 0/1."""
    d = F.col(col).cast("date")
    out = {
        f"{col}__year": F.year(d),
        f"{col}__month": F.month(d),
        f"{col}__day": F.dayofmonth(d),
        f"{col}__dayofweek": F.weekday(d),
        f"{col}__is_weekend": F.weekday(d).isin(5, 6).cast("int"),
        f"{col}__is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        f"{col}__is_month_end": (d == F.last_day(d)).cast("int"),
    }
    if extended:
        out.update({
            f"{col}__quarter": F.quarter(d),
            f"{col}__dayofyear": F.dayofyear(d),
            f"{col}__weekofyear": F.weekofyear(d),
        })
    return df.withColumns(out)


def add_lags(df: DataFrame, value: str, order: list[str], part: list[str] | None = None,
             lags=(1, 2, 3, 7, 30), fill_mean: bool = False) -> DataFrame:
    """FEA-03 row lags; FEA-04 with nulls filled by the series mean."""
    w = _w(part, order)
    mean = F.avg(value).over(Window.partitionBy(*part)) if part else F.avg(value).over(Window.partitionBy())
    cols = {}
    for k in lags:
        c = F.lag(value, k).over(w)
        cols[f"{value}_lag{k}"] = F.coalesce(c, mean) if fill_mean else c
    return df.withColumns(cols)


def rolling(df: DataFrame, value: str, order: list[str], part: list[str] | None = None,
            k: int = 7, stat: str = "mean", full: bool = True, exclude_current: bool = False,
            out: str | None = None) -> DataFrame:
    """FEA-05/06/07/08: rolling mean or sample sd over k rows.

    full=True: null until k rows are in the window (no min_periods);
    full=False: partial windows (min_periods=1).  exclude_current shifts the
    window to the k rows before the current one (no target leakage)."""
    hi = -1 if exclude_current else 0
    w = _w(part, order).rowsBetween(-(k - 1) + hi, hi)
    agg = F.avg(value) if stat == "mean" else F.stddev_samp(value)
    n = F.count(value).over(w)
    c = agg.over(w)
    need = k if full else (2 if stat != "mean" else 1)
    out = out or f"{value}_roll{k}_{stat}"
    return df.withColumn(out, F.when(n >= need, c))


def rsi(df: DataFrame, value: str, order: list[str], part: list[str] | None = None,
        k: int = 14, out: str = "rsi") -> DataFrame:
    """FEA-09: RSI with simple averages of gains and losses over k changes;
    null until k changes exist; 100 when there is no loss."""
    w = _w(part, order)
    delta = F.col(value) - F.lag(value, 1).over(w)
    tmp = df.withColumn("_delta", delta)
    wk = _w(part, order).rowsBetween(-(k - 1), 0)
    gain = F.avg(F.greatest(F.col("_delta"), F.lit(0.0))).over(wk)
    loss = F.avg(F.greatest(-F.col("_delta"), F.lit(0.0))).over(wk)
    n = F.count("_delta").over(wk)
    val = F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / loss))
    return tmp.withColumn(out, F.when(n == k, val)).drop("_delta")


def deviation_flag(df: DataFrame, value: str, order: list[str], part: list[str] | None = None,
                   k: int = 5, z: float = 2.0, out: str = "is_deviation") -> DataFrame:
    """FEA-10: |x - rolling mean(k)| > z * sd of the whole series (partial windows)."""
    wk = _w(part, order).rowsBetween(-(k - 1), 0)
    sd = F.stddev_samp(value).over(Window.partitionBy(*part) if part else Window.partitionBy())
    return df.withColumn(out, (F.abs(F.col(value) - F.avg(value).over(wk)) > z * sd).cast("int"))


def ratio_to_group_mean(df: DataFrame, value: str, group: list[str], out: str | None = None) -> DataFrame:
    """FEA-11: value / mean(value) of its group.  Group means come from one
    aggregation joined back, so a hot group is combined map-side."""
    out = out or f"{value}_ratio_to_mean"
    means = df.groupBy(*group).agg(F.avg(value).alias("_gmean"))
    return df.join(means, group, "left").withColumn(out, F.try_divide(F.col(value), F.col("_gmean"))).drop("_gmean")


def high_season(d: Column, months=(11, 12)) -> Column:
    """FEA-12."""
    return F.month(d).isin(*months).cast("int")


def identifier_features(df: DataFrame, col: str) -> DataFrame:
    """FEA-13: prefix before the first '/' ('UNKNOWN' when null, or when the
    value is '/'), year-pattern flag `/\\d{4}/`, text length."""
    s = F.col(col)
    prefix = F.substring_index(s, "/", 1)
    prefix = F.when(s.isNull() | (s == "/") | (prefix == ""), F.lit("UNKNOWN")).otherwise(prefix)
    return df.withColumns({
        f"{col}_prefix": prefix,
        f"{col}_has_year": F.coalesce(s.rlike(r"/\d{4}/").cast("int"), F.lit(0)),
        f"{col}_length": F.coalesce(F.length(s), F.lit(0)),
    })


def payment_features(df: DataFrame, amount: str, paid: str) -> DataFrame:
    """FEA-14: paid / amount (0 when amount <= 0), double-payment flag, zero-payment flag."""
    a, p = F.col(amount), F.col(paid)
    return df.withColumns({
        "payment_ratio": F.when(a > 0, p / a).otherwise(F.lit(0.0)),
        "is_double_payment": ((p == 2 * a) & (a > 0)).cast("int"),
        "is_zero_payment": (p == 0).cast("int"),
    })


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """FEA-19: z-scores from one aggregation of means and sds (a scalar subquery)."""
    st = one_row(df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols]))
    return df.withColumns({f"{c}_z": F.try_divide(F.col(c) - st[f"_m_{c}"], st[f"_s_{c}"]) for c in cols})


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """FEA-21: product columns a_x_b."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def terciles(df: DataFrame, value: str, out: str = "segment") -> DataFrame:
    """FEA-22: high / medium / low by the exact 1/3 and 2/3 quantiles (rank
    selection, no global sort into one task)."""
    cuts = one_row(exact_quantiles(df, {"_p1": (value, 1 / 3), "_p2": (value, 2 / 3)}))
    seg = (F.when(F.col(value) <= cuts["_p1"], F.lit("low"))
           .when(F.col(value) <= cuts["_p2"], F.lit("medium")).otherwise(F.lit("high")))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), seg))


def calendar_lags(df: DataFrame, value: str, date: str, part: list[str], lags=(1, 7, 30)) -> DataFrame:
    """FEA-03 by the calendar: the value k days earlier, null where that day has
    no row, on a spine without gaps from each series' first to its last day.

    The spine comes from one (first, last) row per series, so it is bounded by
    the calendar.  Each lag is an equi-join on (series, date): the series' days
    are unique keys, so a long series has no hot key.  ``has_row`` tells the
    days of the input from filled ones.  Dates must be unique in a series; a
    null series key is a series, rows without a date are left out."""
    key = [f"_s{i}" for i in range(len(part))]
    rows = df.where(F.col(date).isNotNull()).select(*[F.struct(F.col(p)).alias(k) for p, k in zip(part, key)], date, value)
    spine = rows.groupBy(*key).agg(F.min(date).alias("_a"), F.max(date).alias("_z")) \
        .select(*key, F.explode(F.sequence("_a", "_z")).alias(date))
    out = spine.join(rows.withColumn("has_row", F.lit(True)), [*key, date], "left").withColumn("has_row", F.coalesce("has_row", F.lit(False)))
    for k in lags:
        earlier = rows.select(*key, F.date_add(date, k).alias(date), F.col(value).alias(f"{value}_day_lag{k}"))
        out = out.join(earlier, [*key, date], "left")
    return out.select(*[F.col(f"{k}.{p}").alias(p) for p, k in zip(part, key)], date, value, "has_row", *[f"{value}_day_lag{k}" for k in lags])
