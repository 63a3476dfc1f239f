"""Model evaluation and model metadata (MLT-07..15, 18, 20; FEA-18).

All metrics are single aggregations over (y, prediction) pairs, so they run
with map-side partial aggregation and never gather rows in one task.  AUC
uses a distributed prefix sum over distinct scores (``sequence.prefix_sum``)
instead of a global rank window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.operators.quantiles import exact_quantiles
from sparktab.operators.sequence import one_row, prefix_sum


def class_balance(df: DataFrame, label: str, ratio: float = 0.1) -> DataFrame:
    """FEA-18: class counts, weight n / (k * n_c), and the balance flag
    (min/max class count below ``ratio``)."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    t = one_row(c.agg(F.sum("n").alias("_tot"), F.count(F.lit(1)).alias("_k"),
                      F.min("n").alias("_mn"), F.max("n").alias("_mx")))
    return c.select("label", "n",
                    F.round(t["_tot"] / (t["_k"] * F.col("n")), 6).alias("class_weight"),
                    (t["_mn"] / t["_mx"] < ratio).alias("needs_balancing"))


def regression_metrics(df: DataFrame, y: str, yhat: str, group: list[str] | None = None) -> DataFrame:
    """MLT-09/10: rmse, mse, mae, r2 (null for a constant target), rmsle (null
    when a value is negative)."""
    e = F.col(yhat) - F.col(y)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(F.col(y)))).alias("r2"),
        F.when(F.min(F.least(F.col(y), F.col(yhat))) >= 0,
               F.sqrt(F.avg(F.pow(F.log1p(F.col(yhat)) - F.log1p(F.col(y)), 2)))).alias("rmsle"),
    ]
    return df.groupBy(*(group or [])).agg(*aggs)


def forecast_metrics(df: DataFrame, y: str, yhat: str, naive: str, prev: str) -> DataFrame:
    """MLT-11: MAPE and sMAPE (%), MASE against a naive forecast column,
    directional accuracy (%) against the previous actual, RMSE as % of the mean.
    A zero denominator (exact naive forecast, zero mean) gives null."""
    a, f, nv, pv = F.col(y), F.col(yhat), F.col(naive), F.col(prev)
    return df.agg(
        (F.avg(F.when(a != 0, F.abs((a - f) / a))) * 100).alias("mape"),
        (F.avg(F.when((F.abs(a) + F.abs(f)) != 0, 2 * F.abs(f - a) / (F.abs(a) + F.abs(f)))) * 100).alias("smape"),
        F.try_divide(F.avg(F.abs(a - f)), F.avg(F.abs(a - nv))).alias("mase"),
        (F.avg(F.when(pv.isNotNull(), (F.signum(a - pv) == F.signum(f - pv)).cast("double"))) * 100).alias("directional_accuracy"),
        (F.try_divide(F.sqrt(F.avg((f - a) * (f - a))), F.avg(a)) * 100).alias("rmse_pct_of_mean"),
    )


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """MLT-12 AUC by the rank-sum rule with ties counted half, computed over
    distinct scores with a range-partitioned prefix sum of negatives; null
    when only one class is there."""
    g = df.groupBy(F.col(score).alias("_s")).agg(
        F.sum(F.col(y).cast("long")).alias("_pos"),
        F.sum((1 - F.col(y)).cast("long")).alias("_neg"))
    g = prefix_sum(g, ["_s"], "_neg", "_neg_below", inclusive=False)
    return g.agg(F.try_divide(F.sum(F.col("_pos") * F.col("_neg_below") + 0.5 * F.col("_pos") * F.col("_neg")),
                              F.sum("_pos") * F.sum("_neg")).alias("auc"))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return df.agg((-F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("logloss"))


def classification_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """MLT-13: accuracy, precision, recall, F1 for the positive class 1."""
    tp = F.sum(((F.col(y) == 1) & (F.col(yhat) == 1)).cast("long"))
    fp = F.sum(((F.col(y) == 0) & (F.col(yhat) == 1)).cast("long"))
    fn = F.sum(((F.col(y) == 1) & (F.col(yhat) == 0)).cast("long"))
    acc = F.avg((F.col(y) == F.col(yhat)).cast("double"))
    r = df.agg(acc.alias("accuracy"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return r.select("accuracy", prec.alias("precision"), rec.alias("recall"),
                    F.try_divide(2 * prec * rec, prec + rec).alias("f1"))


def confusion_matrix(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """MLT-14."""
    return df.groupBy(F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def score_quantile(df: DataFrame, score: str, q: float = 0.05, approx: bool = False) -> DataFrame:
    """One-row frame with the q-quantile of the score: exact by rank selection,
    ``approx=True`` by ``percentile_approx``."""
    if approx:
        return df.agg(F.percentile_approx(score, q, 100000).alias("threshold"))
    return exact_quantiles(df, {"threshold": (score, q)})


def anomaly_summary(df: DataFrame, score: str, q: float = 0.05, approx: bool = False) -> DataFrame:
    """MLT-07: mean, sd, min, max, q-quantile, share of rows <= quantile."""
    th = one_row(score_quantile(df, score, q, approx))["threshold"]
    return df.agg(F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"),
                  F.min(score).alias("min_score"), F.max(score).alias("max_score"),
                  F.first(th).alias("threshold"),
                  F.avg((F.col(score) <= th).cast("double")).alias("anomaly_share"))


def anomaly_flag(df: DataFrame, score: str, q: float = 0.05, tail: str = "low", approx: bool = False,
                 out: str = "is_anomaly") -> DataFrame:
    """MLT-08: flag rows at or beyond the quantile (``<=`` on the low tail as
    written in the reference, so all ties are flagged; ``tail='high'`` flags
    score >= the (1-q)-quantile)."""
    qq = q if tail == "low" else 1 - q
    th = one_row(score_quantile(df, score, qq, approx))["threshold"]
    cond = F.col(score) <= th if tail == "low" else F.col(score) >= th
    return df.withColumn(out, cond.cast("int"))


# ---------------------------------------------------------------------------
# fixed values (must equal the reference's): substring ladder of model
# families, tested in this order; "drf" can never match because "rf" comes first
FAMILY_LADDER = [
    (("gbm",), "Gradient Boosting Machine (GBM)", "Tree-based"),
    (("randomforest", "rf"), "Random Forest", "Tree-based"),
    (("xgboost",), "XGBoost", "Tree-based"),
    (("glm",), "Generalized Linear Model (GLM)", "Linear"),
    (("drf",), "Distributed Random Forest", "Tree-based"),
    (("deeplearning", "dl"), "Deep Learning", "Neural Network"),
    (("naivebayes",), "Naive Bayes", "Probabilistic"),
    (("stackedensemble",), "Stacked Ensemble", "Ensemble"),
]
# descriptions by algorithm, of an unknown one, and what a leader's ends with
FAMILY_DESCRIPTIONS = {
    "Gradient Boosting Machine (GBM)": "Gradient boosting ensemble method optimized for accuracy",
    "Random Forest": "Ensemble of decision trees with bootstrap aggregating",
    "XGBoost": "Optimized distributed gradient boosting library",
    "Generalized Linear Model (GLM)": "Linear/logistic regression with regularization",
    "Distributed Random Forest": "Distributed implementation of random forest",
    "Deep Learning": "Multi-layer neural network with backpropagation",
    "Naive Bayes": "Probabilistic classifier based on Bayes theorem",
    "Stacked Ensemble": "Meta-learning ensemble combining multiple base models",
}
UNKNOWN_DESCRIPTION = "H2O AutoML Model"
LEADER_SUFFIX = " (AutoML Leader - Best performing model)"
# ---------------------------------------------------------------------------


def model_family(name: Column) -> tuple[Column, Column, Column]:
    """MLT-18: (algorithm, family, is_leader) from a model name."""
    n = F.lower(name)
    alg = fam = None
    for toks, a, f in reversed(FAMILY_LADDER):
        cond = None
        for t in toks:
            cond = n.contains(t) if cond is None else (cond | n.contains(t))
        alg = F.when(cond, F.lit(a)).otherwise(alg if alg is not None else F.lit("Unknown"))
        fam = F.when(cond, F.lit(f)).otherwise(fam if fam is not None else F.lit("Unknown"))
    leader = n.contains("automl_leader") | n.contains("leader")
    return alg, fam, leader


def model_description(name: Column) -> Column:
    """MLT-18: the description of a model name's algorithm, marked for a leader."""
    alg, _, leader = model_family(name)
    texts = F.create_map(*[F.lit(x) for kv in FAMILY_DESCRIPTIONS.items() for x in kv])
    return F.concat(F.coalesce(texts[alg], F.lit(UNKNOWN_DESCRIPTION)), F.when(leader, F.lit(LEADER_SUFFIX)).otherwise(F.lit("")))


# ---------------------------------------------------------------------------
# fixed values (must equal the reference's): metric display categories
BASIC_KEYS = ["model_name", "model_type", "model_algorithm", "model_family", "model_description",
              "target_column", "file_size_mb", "creation_timestamp", "is_automl_leader"]
ML_KEYS = ["cross_validation", "feature_importance", "partial_dependence", "shap_values"]
PERF_KEYS = ["efficiency_score", "messages_per_minute", "average_message_interval"]
PROCESS_KEYS = ["framework_used", "pipeline_version", "multi_agent_system", "docker_execution"]
# ---------------------------------------------------------------------------


def metric_category(key: Column) -> Column:
    """MLT-20: display category of a metric key, first match wins."""
    return (F.when(key.isin(*BASIC_KEYS), F.lit("basic_info"))
            .when(key.contains("estimated_") | key.isin(*ML_KEYS), F.lit("performance_ml"))
            .when(key.startswith("hp_") | key.contains("automl_"), F.lit("hyperparameters"))
            .when(key.contains("training") | key.contains("duration") | key.contains("time"), F.lit("training"))
            .when(key.isin(*PERF_KEYS), F.lit("performance"))
            .when(key.isin(*PROCESS_KEYS), F.lit("process"))
            .when(key.contains("agent") | key.contains("participation"), F.lit("agent"))
            .otherwise(F.lit("model_specific")))


def feature_importance(model, names: list[str]) -> list[tuple[str, float]]:
    """MLT-15: (feature, importance) pairs from a fitted tree model, descending."""
    imp = model.featureImportances.toArray()
    return sorted(zip(names, [float(x) for x in imp]), key=lambda t: (-t[1], t[0]))
