"""Registered queries: model evaluation, anomaly rules, model metadata (MLT-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktab.operators import models as M
from sparktab.operators.sequence import one_row
from sparktab.plans import views as V
from sparktab.plans.registry import register

# naive fixed predictor on the daily series: the value 7 rows earlier
_PAIRS_SQL = V.with_views("daily_series") + """
, p AS (SELECT series, d, value AS y, lag(value, 7) OVER (PARTITION BY series ORDER BY d) AS yhat,
               lag(value, 1) OVER (PARTITION BY series ORDER BY d) AS prev,
               lag(value, 14) OVER (PARTITION BY series ORDER BY d) AS naive7
        FROM daily_series)
"""


def _pairs(spark, sf):
    s = V.daily_series(V.tables(spark, sf).orders)
    w = Window.partitionBy("series").orderBy("d")
    return s.select("series", "d", F.col("value").alias("y"), F.lag("value", 7).over(w).alias("yhat"),
                    F.lag("value", 1).over(w).alias("prev"), F.lag("value", 14).over(w).alias("naive7"))


def _r(df, n=4):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("mlt_09_10_regression_metrics", sql=_PAIRS_SQL + """
SELECT series, count(*) AS n, round(sqrt(avg((yhat - y) * (yhat - y))), 4) AS rmse, round(avg((yhat - y) * (yhat - y)), 0) AS mse,
  round(avg(abs(yhat - y)), 4) AS mae, round(1 - avg((yhat - y) * (yhat - y)) / var_pop(y), 4) AS r2,
  CASE WHEN min(least(y, yhat)) >= 0 THEN round(sqrt(avg(pow(ln(1 + yhat) - ln(1 + y), 2))), 4) END AS rmsle
FROM p WHERE yhat IS NOT NULL GROUP BY series""")
def mlt_09(spark, sf):
    r = M.regression_metrics(_pairs(spark, sf).where(F.col("yhat").isNotNull()), "y", "yhat", ["series"])
    return _r(r).withColumn("mse", F.round("mse", 0))


@register("mlt_11_forecast_metrics", sql=_PAIRS_SQL + """
SELECT round(avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100, 4) AS mape,
  round(avg(CASE WHEN abs(y) + abs(yhat) <> 0 THEN 2 * abs(yhat - y) / (abs(y) + abs(yhat)) END) * 100, 4) AS smape,
  round(avg(abs(y - yhat)) / avg(abs(y - naive7)), 4) AS mase,
  round(avg(CASE WHEN prev IS NOT NULL THEN CAST(sign(y - prev) = sign(yhat - prev) AS DOUBLE) END) * 100, 4) AS directional_accuracy,
  round(sqrt(avg((yhat - y) * (yhat - y))) / avg(y) * 100, 4) AS rmse_pct_of_mean
FROM p WHERE yhat IS NOT NULL AND naive7 IS NOT NULL""")
def mlt_11(spark, sf):
    p = _pairs(spark, sf).where(F.col("yhat").isNotNull() & F.col("naive7").isNotNull())
    return _r(M.forecast_metrics(p, "y", "yhat", "naive7", "prev"))


# binary classification with a fixed logistic score on document length
_CLS_SQL = """WITH c AS (
  SELECT l.doc_id, l.quality AS y, 1 / (1 + exp(-(ln(d.n_chars) - 7))) AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def _cls(spark, sf):
    t = V.tables(spark, sf)
    d = t.documents.select("doc_id", "n_chars")
    j = t.labels.join(d, "doc_id")
    return j.select("doc_id", F.col("quality").alias("y"),
                    (1 / (1 + F.exp(-(F.log(F.col("n_chars")) - 7)))).alias("p"))


@register("mlt_12_auc_logloss", sql=_CLS_SQL + """
, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM c GROUP BY p)
, r AS (SELECT p, pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round((SELECT sum(pos * below + 0.5 * pos * neg) / (sum(pos) * sum(neg)) FROM r), 6) AS auc,
  round((SELECT -avg(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))) FROM c), 6) AS logloss""")
def mlt_12(spark, sf):
    c = _cls(spark, sf)
    from sparktab.operators.sequence import one_row
    ll = one_row(M.log_loss(c, "y", "p"))["logloss"]
    return _r(M.auc(c, "y", "p").withColumn("logloss", ll), 6)


@register("mlt_13_classification_metrics", sql=_CLS_SQL + """
, k AS (SELECT y, CAST(p >= 0.5 AS INTEGER) AS yhat FROM c)
, t AS (SELECT avg(CAST(y = yhat AS DOUBLE)) AS accuracy, sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS tp,
          sum(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS fn FROM k)
SELECT round(accuracy, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1
FROM t""")
def mlt_13(spark, sf):
    c = _cls(spark, sf).withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    return _r(M.classification_metrics(c, "y", "yhat"), 6)


@register("mlt_14_confusion_matrix", sql=_CLS_SQL + """
SELECT y AS actual, CAST(p >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM c GROUP BY 1, 2""")
def mlt_14(spark, sf):
    c = _cls(spark, sf).withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    return M.confusion_matrix(c, "y", "yhat")


@register("mlt_07_anomaly_score_summary", sql="""
WITH q AS (SELECT quantile_cont(l_discount, 0.05) AS threshold FROM lineitem)
SELECT round(avg(l_discount), 6) AS mean_score, round(stddev_samp(l_discount), 6) AS std_score,
  round(min(l_discount), 6) AS min_score, round(max(l_discount), 6) AS max_score, round(max(threshold), 6) AS threshold,
  round(avg(CAST(l_discount <= threshold AS DOUBLE)), 6) AS anomaly_share
FROM lineitem, q""")
def mlt_07(spark, sf):
    li = V.tables(spark, sf).lineitem.select("l_discount")
    return _r(M.anomaly_summary(li, "l_discount"), 6)


@register("mlt_08_anomaly_flag", sql="""
WITH q AS (SELECT quantile_cont(l_discount, 0.05) AS threshold FROM lineitem)
SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_discount <= threshold THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
  round(avg(CASE WHEN l_discount <= threshold THEN 1.0 ELSE 0.0 END) * 100, 4) AS flagged_pct
FROM lineitem, q GROUP BY l_returnflag""")
def mlt_08(spark, sf):
    li = V.tables(spark, sf).lineitem.select("l_returnflag", "l_discount")
    f = M.anomaly_flag(li, "l_discount", 0.05, tail="low")
    return f.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("is_anomaly").cast("bigint").alias("flagged"),
                                         F.round(F.avg(F.col("is_anomaly").cast("double")) * 100, 4).alias("flagged_pct"))


@register("mlt_18_model_family", sql=V.with_views("models") + """
, m AS (SELECT id, name || CASE WHEN job_id % 10 = 0 AND id % 10 = 1 THEN '_leader' ELSE '' END AS name FROM models)
SELECT CASE WHEN lower(name) LIKE '%gbm%' THEN 'Gradient Boosting Machine (GBM)'
            WHEN lower(name) LIKE '%randomforest%' OR lower(name) LIKE '%rf%' THEN 'Random Forest'
            WHEN lower(name) LIKE '%xgboost%' THEN 'XGBoost'
            WHEN lower(name) LIKE '%glm%' THEN 'Generalized Linear Model (GLM)'
            WHEN lower(name) LIKE '%drf%' THEN 'Distributed Random Forest'
            WHEN lower(name) LIKE '%deeplearning%' OR lower(name) LIKE '%dl%' THEN 'Deep Learning'
            WHEN lower(name) LIKE '%naivebayes%' THEN 'Naive Bayes'
            WHEN lower(name) LIKE '%stackedensemble%' THEN 'Stacked Ensemble' ELSE 'Unknown' END AS algorithm,
       CASE WHEN lower(name) LIKE '%gbm%' THEN 'Tree-based'
            WHEN lower(name) LIKE '%randomforest%' OR lower(name) LIKE '%rf%' THEN 'Tree-based'
            WHEN lower(name) LIKE '%xgboost%' THEN 'Tree-based'
            WHEN lower(name) LIKE '%glm%' THEN 'Linear'
            WHEN lower(name) LIKE '%drf%' THEN 'Tree-based'
            WHEN lower(name) LIKE '%deeplearning%' OR lower(name) LIKE '%dl%' THEN 'Neural Network'
            WHEN lower(name) LIKE '%naivebayes%' THEN 'Probabilistic'
            WHEN lower(name) LIKE '%stackedensemble%' THEN 'Ensemble' ELSE 'Unknown' END AS family,
       lower(name) LIKE '%leader%' AS is_leader, count(*) AS n_models
FROM m GROUP BY ALL""")
def mlt_18(spark, sf):
    m = V.models(V.tables(spark, sf).lineitem)
    name = F.concat(F.col("name"), F.when((F.pmod("job_id", F.lit(10)) == 0) & (F.pmod("id", F.lit(10)) == 1),
                                          F.lit("_leader")).otherwise(F.lit("")))
    alg, fam, lead = M.model_family(name)
    return (m.select(alg.alias("algorithm"), fam.alias("family"), lead.alias("is_leader"))
            .groupBy("algorithm", "family", "is_leader").agg(F.count(F.lit(1)).alias("n_models")))


# ---------------------------------------------------------------- model training
from sparktab.operators import features as FE  # noqa: E402
from sparktab.operators import ml as ML  # noqa: E402
from sparktab.operators import split as SPL  # noqa: E402
from sparktab.operators import telemetry as TM  # noqa: E402

FEATURES = ["d__year", "d__month", "d__day", "d__dayofweek", "d__is_weekend", "d__quarter", "d__dayofyear",
            "d__weekofyear", "value_lag1", "value_lag7", "value_prev7_mean"]


def daily_training_frame(spark, sf):
    """Daily revenue with calendar features, lags 1/7 and the mean of the 7
    previous days (no leakage); rows without lags dropped; temporal split."""
    d = V.daily(V.tables(spark, sf).orders).withColumn("series", F.lit("all"))
    d = FE.calendar_features(d, "d")
    d = FE.add_lags(d, "value", ["d"], ["series"], lags=(1, 7))
    d = FE.rolling(d, "value", ["d"], ["series"], k=7, exclude_current=True, out="value_prev7_mean")
    d = d.na.drop(subset=["value_lag7", "value_prev7_mean"])
    return SPL.temporal_split(d, "d", ["series"])


def _tt(spark, sf):
    d = daily_training_frame(spark, sf)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


@register("mlt_01_03_automl_regression", check="R")
def mlt_01(spark, sf):
    """AutoML regression on the daily series: all 30 candidates by successive
    halving and both ensembles; last rung first, then by RMSE."""
    tr, te = _tt(spark, sf)
    lb, _ = ML.automl_halving(tr, te, FEATURES, "value", "d")
    return lb


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "ship_month", "ship_dayofweek", "p_retailprice", "p_size"]
LINES_A_TASK = 250_000
_LINE_KEY = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
_HASH = "('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT"


def _line_frame(spark, sf):
    """Order lines with their part's price: a frame that grows with the data; an md5 bucket of the line is the split.

    Lines are dealt by part to as many tasks as their number asks for: a scan
    gives as many as the files have row groups, and every pass of a fit,
    whose points Spark keeps by task, would be as narrow."""
    t = V.tables(spark, sf)
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_extendedprice")
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_A_TASK))
    li = lines.where("l_partkey is not null").repartition(parts, "l_partkey").join(t.part.select("p_partkey", "p_retailprice", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    d = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), "l_quantity", "l_discount", "l_tax",
                  F.month("l_shipdate").alias("ship_month"), F.dayofweek("l_shipdate").alias("ship_dayofweek"), "p_retailprice", "p_size",
                  F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    return SPL.random_split(d, "line", (0.8, 0.0), seed=7, method="md5")


@register("mlt_01_03_automl_line_rungs", sql=f"""
WITH t AS (SELECT {_HASH.format(key=_LINE_KEY, seed=42)} AS h, {_HASH.format(key=_LINE_KEY, seed=7)} % 100 < 80 AS train
           FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT rung, status, candidates, (SELECT count(*) FROM t WHERE train AND h < 4294967296 // d) AS train_rows, true AS sorted, true AS all_scored
FROM (VALUES (0, 'stopped', 20, 9), (1, 'stopped', 6, 3), (2, 'finalist', 4, 1)) AS r(rung, status, candidates, d)""")
def mlt_01_rungs(spark, sf):
    """Halving over all 30 candidates on order lines: how many ended at each
    rung, on how many rows, whether each rung is sorted and scored."""
    d = _line_frame(spark, sf)
    lb, _ = ML.automl_halving(d.where("split = 'train'"), d.where("split <> 'train'"), LINE_FEATURES, "l_extendedprice", "line", ensembles=False, together=True)
    w = Window.partitionBy("rung").orderBy("rmse", "model_id")  # a row a model
    lb = lb.withColumn("_up", F.coalesce(F.col("rmse") >= F.lag("rmse").over(w), F.lit(True)))
    return lb.groupBy("rung", "status").agg(F.count(F.lit(1)).alias("candidates"), F.max("train_rows").alias("train_rows"),
                                            F.every("_up").alias("sorted"), F.every(F.col("rmse").isNotNull() & F.col("r2").isNotNull()).alias("all_scored"))


def _doc_frame(spark, sf):
    t = V.tables(spark, sf)
    d = t.documents.select("doc_id", "lang", "source", "n_chars",
                           F.length("text").alias("text_length"),
                           F.size(F.split(F.trim("text"), r"\s+")).alias("n_words"),
                           F.size(F.split("text", "\n")).alias("n_lines"))
    j = t.labels.join(d, "doc_id")
    from pyspark.ml.feature import StringIndexer
    idx = StringIndexer(inputCols=["lang", "source"], outputCols=["lang_idx", "source_idx"], handleInvalid="keep").fit(j)
    j = idx.transform(j)
    return SPL.random_split(j, "doc_id", (0.8, 0.0), method="md5")


_DOC_FEATURES = ["n_chars", "text_length", "n_words", "n_lines", "lang_idx", "source_idx"]


@register("mlt_02_automl_classification", check="R")
def mlt_02(spark, sf):
    """AutoML classification of document quality: leaderboard by AUC, then log loss."""
    j = _doc_frame(spark, sf)
    lb, _ = ML.automl_classification(j.where(F.col("split") == "train"), j.where(F.col("split") != "train"),
                                     _DOC_FEATURES, "quality")
    return lb


@register("mlt_04_stacked_ensemble", sql=f"""
SELECT model_id, 'ensemble' AS status, true AS weights_not_negative,
  (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {_HASH.format(key=_LINE_KEY, seed=7)} % 100 >= 80) AS scored,
  true AS rmse_within_2_pct_of_best_base
FROM (VALUES ('StackedEnsemble_AllModels'), ('StackedEnsemble_BestOfFamily')) AS t(model_id)""")
def mlt_04(spark, sf):
    """Ensembles of all last-rung models and of the best of each family on order
    lines: their weights, the rows they score, their error beside the best base."""
    d = _line_frame(spark, sf)
    test = d.where("split <> 'train'")
    lb, models = ML.automl_halving(d.where("split = 'train'"), test, LINE_FEATURES, "l_extendedprice", "line", together=True)
    best = one_row(lb.where("status = 'finalist'").agg(F.min("rmse").alias("rmse")))["rmse"]
    seen = None
    for m in models.values():
        if isinstance(m, ML.StackedModel):
            got = m.transform(test).agg(F.lit(m.name).alias("model_id"), F.lit(all(w >= 0 for w in m.weights.values())).alias("weights_not_negative"),
                                        F.count("prediction").alias("scored"))
            seen = got if seen is None else seen.unionByName(got)
    return lb.where("status = 'ensemble'").join(seen, "model_id").select(
        "model_id", "status", "weights_not_negative", "scored", (F.col("rmse") <= best * 1.02).alias("rmse_within_2_pct_of_best_base"))


def _iforest(spark, sf):
    li = V.tables(spark, sf).lineitem
    feats = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    model = ML.fit_isolation_forest(li, feats, ["l_orderkey", "l_linenumber", "l_partkey"], n_trees=100,
                                    sample_rate=0.8, max_depth=8)
    return model, li.select("l_orderkey", "l_linenumber", *feats)


@register("mlt_05_isolation_forest_scores", check="R")
def mlt_05(spark, sf):
    """Isolation forest (100 trees, row sample 0.8, depth 8) scoring every lineitem row."""
    model, li = _iforest(spark, sf)
    return model.transform(li, spread=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "anomaly_score")


@register("mlt_05_isolation_forest_planted", sql="""
SELECT count(*) + (SELECT count(*) FROM lineitem WHERE l_orderkey % 500 = 0) AS n_rows,
  (SELECT count(*) FROM lineitem WHERE l_orderkey % 500 = 0) AS planted, true AS scores_in_range, true AS planted_above_all_means,
  true AS flag_share_is_5_pct, 1.0::DOUBLE AS planted_flagged
FROM lineitem""")
def mlt_05_planted(spark, sf):
    """Every line, and a copy of some with values far outside: properties of a fit and a score over all of them."""
    from sparktab.operators.sequence import stable
    feats = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    li = V.tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *feats)
    far = li.where(F.col("l_orderkey") % 500 == 0).select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"), "l_partkey",
                                                          (F.col("l_extendedprice") * 10 + 1e6).alias("l_extendedprice"), (F.col("l_quantity") * 20 + 1000).alias("l_quantity"),
                                                          (F.col("l_discount") + 5).alias("l_discount"), (F.col("l_tax") + 5).alias("l_tax"))
    rows = li.withColumn("planted", F.lit(False)).unionByName(far.withColumn("planted", F.lit(True)))
    model = ML.fit_isolation_forest(rows, feats, ["l_orderkey", "l_linenumber", "l_partkey"])
    scored = stable(model.transform(rows, spread=["l_orderkey", "l_linenumber"]).select("planted", "anomaly_score"))
    flagged = M.anomaly_flag(scored, "anomaly_score", 0.05, tail="high")
    means = lambda p: F.avg(F.when(F.col("planted") == p, F.col("anomaly_score")))
    share = F.avg(F.col("is_anomaly").cast("double"))
    return flagged.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("planted").alias("planted"), F.every((F.col("anomaly_score") > 0) & (F.col("anomaly_score") <= 1)).alias("scores_in_range"),
                       (means(True) > means(False)).alias("planted_above_all_means"), ((share >= 0.05) & (share < 0.06)).alias("flag_share_is_5_pct"),
                       F.round(F.avg(F.when(F.col("planted"), F.col("is_anomaly").cast("double"))), 6).alias("planted_flagged"))


@register("mlt_05_07_isolation_forest_summary", check="R")
def mlt_05_summary(spark, sf):
    """Score summary and the 5 % high tail flag on the isolation-forest scores."""
    model, li = _iforest(spark, sf)
    from sparktab.operators.sequence import one_row, stable
    s = stable(model.transform(li, spread=["l_orderkey", "l_linenumber"]).select("anomaly_score"))
    summ = M.anomaly_summary(s, "anomaly_score", 0.95)
    flagged = one_row(M.anomaly_flag(s, "anomaly_score", 0.05, tail="high").agg(
        F.avg("is_anomaly").alias("share")))["share"]
    return summ.withColumn("flagged_share", flagged)


@register("mlt_06_kmeans", check="R")
def mlt_06(spark, sf):
    c = V.tables(spark, sf).customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    m = ML.kmeans(c, ["c_acctbal", "nation"], k=4)
    return m.transform(c).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@register("mlt_15_feature_importance", check="R")
def mlt_15(spark, sf):
    """GBM feature importances, descending (the VIZ-07 bars)."""
    from pyspark.ml.regression import GBTRegressor
    tr, _ = _tt(spark, sf)
    from pyspark.ml import Pipeline
    m = Pipeline(stages=[ML._assembler(FEATURES), GBTRegressor(maxIter=20, seed=42)]).fit(ML._prep(tr, FEATURES, "value"))
    return ML.importance_frame(spark, m, FEATURES)


@register("mlt_16_save_load_roundtrip", check="R")
def mlt_16(spark, sf):
    """Save a fitted pipeline to the shared folder, load it, score again: equal."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import RandomForestRegressor
    from sparktab.session import checkpoint_path
    tr, te = _tt(spark, sf)
    m = Pipeline(stages=[ML._assembler(FEATURES), RandomForestRegressor(numTrees=20, seed=42)]).fit(ML._prep(tr, FEATURES, "value"))
    path = checkpoint_path(spark, "model")
    ML.save_model(m, path)
    m2 = ML.load_model(path)
    a = m.transform(te).select("d", F.col("prediction").alias("p1"))
    b = m2.transform(te).select("d", F.col("prediction").alias("p2"))
    return a.join(b, "d").agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("p1") - F.col("p2"))).alias("max_abs_diff"))


@register("mlt_21_early_stopping", check="R")
def mlt_21(spark, sf):
    """GBT with a validation indicator and tolerance 0.001; AutoML loop with 3 stopping rounds."""
    tr, te = _tt(spark, sf)
    d = tr.withColumn("is_valid", F.pmod(F.dayofmonth("d"), F.lit(5)) == 0)
    m = ML.gbt_early_stopping(d, FEATURES, "value", "is_valid", tol=0.001)
    lb, _ = ML.automl_regression(tr, te, FEATURES, "value", stop_rounds=3, tolerance=0.001)
    return lb.agg(F.count(F.lit(1)).alias("candidates_tried")).withColumn("gbt_trees", F.lit(m.stages[-1].getNumTrees))


_MET_COLS = ["model_name", "model_algorithm", "total_agent_messages", "agents_used", "most_active_agent",
             "least_active_agent", "training_duration_seconds", "training_duration_minutes", "messages_per_minute",
             "average_message_interval", "efficiency_score"]


@register("mlt_20_metrics_grouping", sql=V.with_views("agent_events", "models") + """
, ev AS (SELECT job_id, count(*) AS n FROM agent_events GROUP BY job_id)
, fam AS (SELECT id, job_id, name FROM models)
, m AS (SELECT ev.job_id, fam.name AS model_name, ev.n AS total_agent_messages FROM ev LEFT JOIN fam ON ev.job_id = fam.job_id)
, kv AS (SELECT job_id, 'model_name' AS key FROM m WHERE model_name IS NOT NULL
         UNION ALL SELECT job_id, 'total_agent_messages' FROM m
         UNION ALL SELECT job_id, 'agents_used' FROM m UNION ALL SELECT job_id, 'most_active_agent' FROM m
         UNION ALL SELECT job_id, 'training_duration_seconds' FROM m UNION ALL SELECT job_id, 'messages_per_minute' FROM m
         UNION ALL SELECT job_id, 'efficiency_score' FROM m UNION ALL SELECT job_id, 'framework_used' FROM m)
SELECT CASE WHEN key IN ('model_name','model_type','model_algorithm','model_family','model_description','target_column','file_size_mb','creation_timestamp','is_automl_leader') THEN 'basic_info'
            WHEN contains(key, 'estimated_') OR key IN ('cross_validation','feature_importance','partial_dependence','shap_values') THEN 'performance_ml'
            WHEN starts_with(key, 'hp_') OR contains(key, 'automl_') THEN 'hyperparameters'
            WHEN contains(key, 'training') OR contains(key, 'duration') OR contains(key, 'time') THEN 'training'
            WHEN key IN ('efficiency_score','messages_per_minute','average_message_interval') THEN 'performance'
            WHEN key IN ('framework_used','pipeline_version','multi_agent_system','docker_execution') THEN 'process'
            WHEN contains(key, 'agent') OR contains(key, 'participation') THEN 'agent' ELSE 'model_specific' END AS category,
       count(*) AS n_metrics
FROM kv GROUP BY 1""")
def mlt_20(spark, sf):
    """Extended metrics per model of a job as JSON, exploded to keys and grouped by the
    display-category ladder (absent values are not keys, as in JSON)."""
    t = V.tables(spark, sf)
    ev = V.agent_events(t.events)
    r = TM.run_metrics(ev)
    fam = V.models(t.lineitem).select("job_id", F.col("name").alias("model_name"))
    m = r.join(fam, "job_id", "left").select(
        "job_id", "model_name", F.col("n").alias("total_agent_messages"), F.col("n_agents").alias("agents_used"),
        "most_active_agent", F.round("execution_time", 2).alias("training_duration_seconds"), "messages_per_minute",
        "efficiency_score", F.lit("Spark ML").alias("framework_used"))
    js = m.select("job_id", F.to_json(F.struct(*[c for c in m.columns if c != "job_id"])).alias("metrics"))
    kv = js.select("job_id", F.explode(F.map_keys(F.from_json("metrics", "map<string,string>"))).alias("key"))
    return kv.groupBy(M.metric_category(F.col("key")).alias("category")).agg(F.count(F.lit(1)).alias("n_metrics"))


# ---------------------------------------------------------------- feature pipeline helpers
from sparktab.operators import steps as STP  # noqa: E402
from sparktab.operators import forecast as FCM  # noqa: E402


@register("fea_15_categorical_encoding", sql="""
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, CAST(row_number() OVER (ORDER BY n DESC, lang) - 1 AS DOUBLE) AS lang_idx, n FROM c""")
def fea_15(spark, sf):
    """StringIndexer + one-hot encoding of flagged categorical columns."""
    d = V.tables(spark, sf).documents.select("doc_id", "lang", "source")
    enc, _ = STP.encode_categoricals(d, ["lang", "source"])
    return enc.groupBy("lang", "lang_idx").agg(F.count(F.lit(1)).alias("n"))


VECTOR_BYTES_A_TASK = 32 * 1024 * 1024
_EVENT_TEXTS = {"event_type": "event_type", "user_name": "'user ' || CAST(user_id AS VARCHAR)", "weekday": "strftime(ts, '%a')", "event_text": "CAST(event_id AS VARCHAR)"}


@register("fea_15_flagged_one_hot", sql="WITH v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {e} AS value, count(*) AS n FROM events GROUP BY 2" for c, e in _EVENT_TEXTS.items()) + """)
, r AS (SELECT column_name FROM v WHERE value IS NOT NULL GROUP BY column_name HAVING round(count(*) / (SELECT count(*) FROM events), 4) <= 0.05)
, i AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) - 1 AS idx, count(*) OVER (PARTITION BY column_name) AS k
        FROM v WHERE value IS NOT NULL AND column_name IN (SELECT column_name FROM r))
SELECT column_name, value, CAST(idx AS DOUBLE) AS value_index, k AS n_values, n, repeat('0', CAST(idx AS INTEGER)) || '1' || repeat('0', CAST(k - idx - 1 AS INTEGER)) AS one_hot FROM i""")
def fea_15_flagged(spark, sf):
    """Text columns of the events flagged by their share of distinct values,
    indexed and one-hot encoded; one row per value with its vector, which is
    spelled out once a value, not once an event."""
    e = V.tables(spark, sf).events.select("event_type", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("user_name"),
                                          F.date_format("ts", "E").alias("weekday"), F.col("event_id").cast("string").alias("event_text"))
    flagged = STP.flagged_categoricals(e)
    enc, (index, _) = STP.encode_categoricals(e.select(*flagged), flagged)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), F.col(f"{c}_idx").alias("value_index"), F.lit(len(labels)).cast("bigint").alias("n_values"), STP.hot_place(F.col(f"{c}_ohe")).alias("_hot"))
            for c, labels in zip(flagged, index.labelsArray)]
    values = enc.select(F.inline(F.array(*rows))).groupBy("column_name", "value", "value_index", "n_values", "_hot").agg(F.count(F.lit(1)).alias("n"))
    size = sum(len(labels) ** 2 for labels in index.labelsArray)  # characters of all vectors: they grow by the square of the values
    values = values.repartition(max(spark.sparkContext.defaultParallelism, -(-size // VECTOR_BYTES_A_TASK)), "column_name", "value_index")
    return values.select("column_name", "value", "value_index", "n_values", STP.one_hot_text(F.col("_hot"), F.col("n_values")).alias("one_hot"), "n")


@register("fea_16_feature_list", check="R")
def fea_16(spark, sf):
    """All columns but the target and the raw date go into the assembler."""
    d = daily_training_frame(spark, sf)
    feats = STP.feature_list(d, "value", drop=("d", "series", "split"))
    return spark.createDataFrame([(i, f) for i, f in enumerate(feats)], "position int, feature string")


@register("fea_17_align_scoring_frame", dates=["d"], sql=V.with_views("daily") + """
, s AS (SELECT CAST(unnest(generate_series(max(d) + 1, max(d) + 30, INTERVAL 1 DAY)) AS DATE) AS d FROM daily)
SELECT d, year(d) AS d__year, month(d) AS d__month, day(d) AS d__day, isodow(d) - 1 AS d__dayofweek,
  CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS d__is_weekend, quarter(d) AS d__quarter, dayofyear(d) AS d__dayofyear,
  weekofyear(d) AS d__weekofyear, 0 AS value_lag1, 0 AS value_lag7, 0 AS value_prev7_mean FROM s""")
def fea_17(spark, sf):
    """Future rows aligned to the model's columns; absent ones filled with 0."""
    h = V.daily(V.tables(spark, sf).orders)
    fut = FE.calendar_features(FCM.spine(h, "d", [], 30, "D"), "d")
    return STP.align_columns(fut, ["d"] + FEATURES, 0)


@register("fea_20_drop_correlated_features", check="R")
def fea_20(spark, sf):
    """Of each feature pair with |r| > 0.95 the later one is dropped."""
    d = daily_training_frame(spark, sf)
    keep = STP.drop_correlated(d, FEATURES, 0.95)
    return spark.createDataFrame([(f, f in keep) for f in FEATURES], "feature string, kept boolean")


def _future_frame(spark, sf):
    """Future spine with calendar features and the history carried forward
    (lags frozen over the horizon, as in the reference)."""
    h = V.daily(V.tables(spark, sf).orders)
    fut = FCM.frozen_forecast(h, "value", "d", [], 30, "D")
    fut = FE.calendar_features(fut, "d").select(
        "d", *[c for c in FEATURES if c.startswith("d__")], F.col("lag_1").alias("value_lag1"),
        F.col("lag_7").alias("value_lag7"), F.col("rolling_mean_7").alias("value_prev7_mean"))
    return fut


@register("fct_03_score_future_with_model", check="R")
def fct_03(spark, sf):
    """A random forest trained on the daily features scores the 30-day future spine."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import RandomForestRegressor
    tr, _ = _tt(spark, sf)
    m = Pipeline(stages=[ML._assembler(FEATURES), RandomForestRegressor(numTrees=30, maxDepth=6, seed=42)]).fit(
        ML._prep(tr, FEATURES, "value"))
    return m.transform(_future_frame(spark, sf)).select("d", "prediction")


def _small_gbt(tr, features, label):
    """The last resort of a chain: a small GBT, trained when the chain gets to it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor
    return lambda: Pipeline(stages=[ML._assembler(features), GBTRegressor(maxIter=10, maxDepth=3, seed=42)]).fit(ML._prep(tr, features, label))


@register("fct_10_fallback_chain", check="R")
def fct_10(spark, sf):
    """Leader -> base model -> a small GBT trained on the spot; here the leader lacks a column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    tr, _ = _tt(spark, sf)
    prepared = ML._prep(tr, FEATURES, "value").withColumn("leader_only_feature", F.lit(1.0))
    leader = Pipeline(stages=[ML._assembler(FEATURES + ["leader_only_feature"]), LinearRegression()]).fit(prepared)
    base = Pipeline(stages=[ML._assembler(FEATURES), GBTRegressor(maxIter=10, seed=42)]).fit(ML._prep(tr, FEATURES, "value"))
    out, used, _ = FCM.score_with_fallback(_future_frame(spark, sf), [("leader", leader), ("base", base), ("small_gbt", _small_gbt(tr, FEATURES, "value"))])
    return out.select("d", "prediction").withColumn("model", F.lit(used))


@register("fct_10_fallback_at_run_time", sql="""
SELECT position, model, step, failed, CASE WHEN failed THEN 0 ELSE (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey) END AS scored_rows
FROM (VALUES (1, 'leader', 'run', true), (2, 'base', 'analysis', true), (3, 'small_gbt', 'done', false)) AS t(position, model, step, failed)""")
def fct_10_run(spark, sf):
    """Every order line scored by a chain whose leader breaks on a few rows only
    (a missing value that it doesn't take), and whose base model lacks a column:
    the small GBT is trained then and scores them all."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    d = _line_frame(spark, sf).cache()  # fits and scores pass over it many times: dealt once
    tr = d.where("split = 'train'")
    strict = VectorAssembler(inputCols=LINE_FEATURES, outputCol="features", handleInvalid="error")
    prepared = ML._prep(tr, LINE_FEATURES, "l_extendedprice")
    leader = Pipeline(stages=[strict, LinearRegression(regParam=0.01)]).fit(prepared)
    base = Pipeline(stages=[ML._assembler(LINE_FEATURES + ["l_rank"]), LinearRegression(regParam=0.01)]).fit(prepared.withColumn("l_rank", F.lit(1.0)))
    holed = d.withColumn("l_tax", F.when(~F.col("line").endswith("7-1"), F.col("l_tax")))
    out, used, tried = FCM.score_with_fallback(holed, [("leader", leader), ("base", base), ("small_gbt", _small_gbt(tr, LINE_FEATURES, "l_extendedprice"))],
                                               probe_rows=0)  # the fault must show in the run over all rows
    d.unpersist()  # the scored frame is written
    n = one_row(out.agg(F.count("prediction").alias("n")))["n"]
    return tried.select("position", "model", "step", "failed", F.when(F.col("model") == used, n).otherwise(F.lit(0)).alias("scored_rows"))


from sparktab.plans import sqlfrag as _SQ  # noqa: E402

_UDF02_SQL = V.with_views("localised") + f"""
, t AS (SELECT trim(fecha) AS fecha, trim(monto_total) AS monto_total, d FROM localised)
, p AS (SELECT *, {_SQ.parse_lenient('fecha')} AS fecha_date,
               try_cast(replace(replace(replace(monto_total, '.', ''), ' ', ''), ',', '.') AS DOUBLE) AS amount FROM t)
SELECT *, year(fecha_date) AS fecha_date__year, month(fecha_date) AS fecha_date__month, day(fecha_date) AS fecha_date__day,
  isodow(fecha_date) - 1 AS fecha_date__dayofweek, CASE WHEN isodow(fecha_date) >= 6 THEN 1 ELSE 0 END AS fecha_date__is_weekend,
  CASE WHEN day(fecha_date) = 1 THEN 1 ELSE 0 END AS fecha_date__is_month_start,
  CASE WHEN fecha_date = last_day(fecha_date) THEN 1 ELSE 0 END AS fecha_date__is_month_end FROM p"""


@register("udf_02_user_steps", dates=["d", "fecha_date"], sql=_UDF02_SQL)
def udf_02(spark, sf):
    """User steps added in order and applied with DataFrame.transform."""
    from sparktab.functions import dates as DT
    from sparktab.functions import numbers as NB
    from sparktab.operators import clean as CL
    s = (STP.Steps()
         .add_step("trim", CL.trim_all)
         .add_step("parse_dates", lambda df: df.withColumn("fecha_date", DT.parse_localised(F.col("fecha"))))
         .add_step("parse_numbers", lambda df: df.withColumn("amount", NB.parse_european(F.col("monto_total"))))
         .add_step("calendar", lambda df: FE.calendar_features(df, "fecha_date", extended=False)))
    return s.run(V.localised(V.tables(spark, sf).orders))


@register("udf_03_custom_model", check="R")
def udf_03(spark, sf):
    """A user estimator registered by name joins the AutoML candidates."""
    from pyspark.ml.regression import RandomForestRegressor
    ML.register_custom_model("Custom_shallow_forest", RandomForestRegressor(numTrees=10, maxDepth=3, seed=7))
    try:
        tr, te = _tt(spark, sf)
        lb, _ = ML.automl_halving(tr, te, FEATURES, "value", "d", ensembles=False)
    finally:
        ML.CUSTOM_MODELS.pop("Custom_shallow_forest", None)
    return lb


@register("udf_04_grouped_python_compute", check="R")
def udf_04(spark, sf):
    """Grouped pandas compute (applyInPandas): one isolation tree per group,
    each built from its bounded sample; tree sizes per tree."""
    model, _li = _iforest(spark, sf)
    nodes = spark.createDataFrame(model.nodes)
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"),
                                     F.max(F.when(F.col("node") == 0, F.col("size"))).alias("sample_rows"))


@register("viz_07_importance_bars", check="R")
def viz_07(spark, sf):
    """Feature-importance bars, descending, with their display order."""
    from pyspark.sql import Window
    imp = mlt_15(spark, sf)
    return imp.withColumn("bar", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
