"""Forecasting (FCT-*): future date spine per series, history carried into the
future, history+forecast union, bands, intervals and run summaries.

The spine is generated per series from its last date (a one-row range per
series, exploded), so it costs O(series x horizon).  History carried into the
future comes from the last 30 rows per series, taken with the skew-safe
``top_k``; a long series never sorts in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.operators.profile import top_k
from sparktab.operators.sequence import one_row, stable


def future_dates(last: Column, horizon: int = 30, freq: str = "D") -> Column:
    """FCT-01: array of ``horizon`` dates after ``last``: D days, W Mondays
    from a week later, M month ends from the next month; other values act as D."""
    if freq == "W":
        first = F.next_day(F.date_add(last, 6), "Mon")
        return F.sequence(first, F.date_add(first, 7 * (horizon - 1)), F.expr("INTERVAL 7 DAYS"))
    if freq == "M":
        start = F.add_months(F.trunc(last, "MM"), 1)
        return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.last_day(F.add_months(start, i)))
    return F.sequence(F.date_add(last, 1), F.date_add(last, horizon))


def spine(history: DataFrame, date: str = "d", part: list[str] | None = None, horizon: int = 30,
          freq: str = "D") -> DataFrame:
    """FCT-01/02: (series..., d, step) future rows after the max date of each series."""
    part = part or []
    last = history.groupBy(*part).agg(F.max(date).alias("_last"))
    return last.select(*part, F.posexplode(future_dates(F.col("_last"), horizon, freq)).alias("step", date)) \
               .withColumn("step", F.col("step") + 1)


def carried_history(history: DataFrame, value: str = "value", date: str = "d",
                    part: list[str] | None = None) -> DataFrame:
    """FCT-04: last value, mean of the last 7 and last 30 rows per series
    (fewer rows: the mean of what exists), as the reference freezes them."""
    part = part or []
    tail = top_k(history.select(*part, date, value), part, [F.desc(date)], 30, out="_r")
    g = tail.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(value, date).alias("lag_1"),
        F.avg(F.when(F.col("_r") <= 7, F.col(value))).alias("_m7"),
        F.avg(value).alias("_m30"))
    return g.select(*part, "lag_1",
                    F.when(F.col("_n") >= 30, F.col("_m7")).otherwise(F.col("_m30")).alias("lag_7"),
                    F.col("_m30").alias("lag_30"),
                    F.when(F.col("_n") >= 7, F.col("_m7")).otherwise(F.col("_m30")).alias("rolling_mean_7"),
                    F.col("_m30").alias("rolling_mean_30"))


def frozen_forecast(history: DataFrame, value: str = "value", date: str = "d", part: list[str] | None = None,
                    horizon: int = 30, freq: str = "D", predictor: str = "rolling_mean_7") -> DataFrame:
    """Spine + carried history; the prediction is a carried feature (a
    deterministic baseline; a fitted model scores the same frame in FCT-03)."""
    part = part or []
    s = spine(history, date, part, horizon, freq)
    c = carried_history(history, value, date, part)
    j = s.join(c, part) if part else s.select(*s.columns, one_row(c).alias("_c")).select(*s.columns, "_c.*")
    return j.withColumn("prediction", F.col(predictor))


def with_history(history: DataFrame, forecast: DataFrame, value: str = "value", date: str = "d",
                 part: list[str] | None = None) -> DataFrame:
    """FCT-05: history and forecast in one table with a ``type`` column
    (predictions copied from actuals for history)."""
    part = part or []
    h = history.select(*part, date, F.col(value).alias("actual"), F.col(value).alias("prediction"),
                       F.lit("historical").alias("type"))
    f = forecast.select(*part, date, F.lit(None).cast("double").alias("actual"), "prediction",
                        F.lit("prediction").alias("type"))
    return h.unionByName(f)


def band(forecast: DataFrame, history: DataFrame, value: str = "value", part: list[str] | None = None,
         z: float = 1.0, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """FCT-06 (z = 1: prediction +- sd of history) and FCT-07 (z = 1.96 with
    the residual sd as ``history``/``value``)."""
    part = part or []
    sd = history.groupBy(*part).agg(F.stddev_samp(value).alias("_sd"))
    j = forecast.join(sd, part) if part else forecast.withColumn("_sd", one_row(sd)["_sd"])
    return j.withColumn(lower, F.col("prediction") - z * F.col("_sd")) \
            .withColumn(upper, F.col("prediction") + z * F.col("_sd")).drop("_sd")


def change_pct(history: DataFrame, forecast: DataFrame, value: str = "value", date: str = "d",
               part: list[str] | None = None) -> DataFrame:
    """FCT-08: first forecast against the last actual, in percent (null if that is 0)."""
    part = part or []
    last = history.groupBy(*part).agg(F.max_by(value, date).alias("last_actual"))
    first = forecast.groupBy(*part).agg(F.min_by("prediction", date).alias("first_forecast"))
    j = last.join(first, part) if part else last.withColumn("first_forecast", one_row(first)["first_forecast"])
    return j.withColumn("change_pct", F.try_divide(F.col("first_forecast") - F.col("last_actual"), F.col("last_actual")) * 100)


def score_summary(scored: DataFrame, col: str = "prediction") -> DataFrame:
    """FCT-09."""
    return scored.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"),
                      F.stddev_samp(col).alias("std"), F.count(F.lit(1)).alias("rows"))


def run_summary(scored: DataFrame, date: str, model_name: str, features: list[str]) -> DataFrame:
    """FCT-11: rows, model, feature list, date range of a scoring run."""
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date")) \
                 .select(F.lit(model_name).alias("model"), F.lit(",".join(features)).alias("features"), "*")


ATTEMPTS = "position int, model string, step string, failed boolean, error string"


def score_with_fallback(df: DataFrame, chain: list, probe_rows: int = 1000):
    """FCT-10: score ``df`` with the first model of an ordered chain that gets
    through every row.  ``chain``: (name, model, or a function that trains one
    when the chain gets there) pairs.

    A model fails at ``train``, at ``analysis`` (a missing column), on a
    ``probe`` of at most ``probe_rows`` rows (cheap, most faults show there; a
    probe without a usable prediction counts as a fault; 0: no probe), or while the
    whole frame is scored (``run``: a fault in any row).  The scored frame is written
    once to the shared checkpoint folder, so it was computed in full before it is returned.

    Returns (scored frame, name of the model, attempts: position, model, step,
    failed, error).  An empty frame is scored by the first model that passes
    analysis.  Raises if no model gets through, with every model's error."""
    tried = []
    for i, (name, model) in enumerate(chain, 1):
        step = "train"
        try:
            if not hasattr(model, "transform"):
                model = model()
            step = "analysis"
            out = model.transform(df)
            out.schema  # noqa: B018 - analysis happens here
            step = "probe"
            p = F.col("prediction")
            got = out.limit(probe_rows).agg(F.count(F.lit(1)).alias("n"), F.count_if(p.isNotNull() & ~F.isnan(p)).alias("ok")).first()
            if got["n"] and not got["ok"]:
                raise ValueError("no usable prediction")
            step = "run"
            out = stable(out)
        except Exception as e:  # noqa: BLE001 - any failure of a model moves down the chain, and is reported
            tried.append((i, name, step, True, f"{type(e).__name__}: {' '.join(str(e).split())[:300]}"))
            continue
        tried.append((i, name, "done", False, None))
        return out, name, df.sparkSession.createDataFrame(tried, ATTEMPTS)
    raise RuntimeError("no model of the chain could score: " + "; ".join(f"{t[1]} at {t[2]}: {t[4]}" for t in tried))
