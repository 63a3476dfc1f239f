"""Model training, selection and scoring (MLT-01..06, 15, 16, 21; UDF-03/04).

AutoML is a loop over ``pyspark.ml`` estimators (each fit is distributed)
that stops between candidates when the time budget is spent, never inside
one.  The isolation forest is the only custom algorithm: all trees grow level
by level from minima and maxima per (tree, node); rows are assigned
to trees by a hash of their key, so no row is copied per tree.  The trees (at
most ``n_trees * 2^(depth+1)`` nodes) are shipped to executors and every row
is scored with a pandas UDF in Arrow batches."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression,
                                   LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.operators import models as M
from sparktab.operators import trees as TR
from sparktab.operators.sequence import stable
from sparktab.operators.split import HASH_RANGE, key_hash

# ---------------------------------------------------------------- registry
CUSTOM_MODELS: dict[str, object] = {}


def register_custom_model(name: str, estimator) -> None:
    """UDF-03: add a ``pyspark.ml`` estimator (featuresCol='features',
    labelCol='label') to the AutoML candidates."""
    CUSTOM_MODELS[name] = estimator


def _reg_candidates(seed: int):
    base = [
        ("GLM_elasticnet_1", LinearRegression(elasticNetParam=0.5, regParam=0.01, maxIter=50)),
        ("DecisionTree_1", DecisionTreeRegressor(maxDepth=6, seed=seed)),
        ("DRF_1", RandomForestRegressor(numTrees=30, maxDepth=8, seed=seed)),
        ("GBM_1", GBTRegressor(maxIter=30, maxDepth=5, seed=seed)),
        ("GLM_gaussian_1", GeneralizedLinearRegression(family="gaussian", regParam=0.01, maxIter=50)),
    ]
    variants = []
    for i in range(2, 7):
        variants += [
            (f"GLM_elasticnet_{i}", LinearRegression(elasticNetParam=0.1 * i, regParam=0.01 * i, maxIter=50)),
            (f"DRF_{i}", RandomForestRegressor(numTrees=20 + 10 * i, maxDepth=4 + i, seed=seed + i)),
            (f"GBM_{i}", GBTRegressor(maxIter=20 + 2 * i, maxDepth=3 + (i % 4), stepSize=0.05 * i, seed=seed + i)),
            (f"DecisionTree_{i}", DecisionTreeRegressor(maxDepth=3 + i, seed=seed + i)),
            (f"GLM_gaussian_{i}", GeneralizedLinearRegression(family="gaussian", regParam=0.02 * i, maxIter=50)),
        ]
    return base + variants


def _cls_candidates(seed: int):
    return [
        ("GLM_logistic_1", LogisticRegression(regParam=0.01, elasticNetParam=0.0, maxIter=50)),
        ("DRF_1", RandomForestClassifier(numTrees=30, maxDepth=6, seed=seed)),
        ("GBM_1", GBTClassifier(maxIter=30, maxDepth=4, seed=seed)),
        ("NaiveBayes_1", NaiveBayes(modelType="gaussian")),
        ("GLM_logistic_2", LogisticRegression(regParam=0.1, elasticNetParam=0.5, maxIter=50)),
        ("DRF_2", RandomForestClassifier(numTrees=60, maxDepth=8, seed=seed + 1)),
        ("GBM_2", GBTClassifier(maxIter=30, maxDepth=5, stepSize=0.1, seed=seed + 1)),
    ]


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def _prep(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.select(*features, F.col(label).cast("double").alias("label"),
                     *[c for c in df.columns if c not in features and c != label])


def _run_candidates(cands, fit_one, budget_s: float, parallelism: int, stop=None):
    """Fit candidates in waves of ``parallelism`` concurrent Spark jobs (the
    ``CrossValidator(parallelism=)`` idea); after the first, no new wave starts
    once the budget is spent (a running fit is never cut).  A candidate whose fit fails in a
    worker thread is fitted again on the calling thread before the next wave,
    so a failure surfaces with its own error, not a thread's."""
    from concurrent.futures import ThreadPoolExecutor

    def attempt(c):
        try:
            return c, fit_one(c), None
        except Exception as e:  # noqa: BLE001 - retried below
            return c, None, e

    t0, results = time.time(), []
    width = max(1, parallelism)
    with ThreadPoolExecutor(max_workers=width) as pool:
        for i in range(0, len(cands), width):
            if i and budget_s is not None and time.time() - t0 > budget_s:
                warnings.warn(f"time budget spent; not fitted: {[c[0] for c in cands[i:]]}", stacklevel=3)
                break
            for c, res, err in pool.map(attempt, cands[i:i + width]):
                results.append(res if err is None else fit_one(c))
            if stop and stop(results):
                break
    return results


def automl_regression(train: DataFrame, valid: DataFrame, features: list[str], label: str,
                      max_models: int | None = None, budget_s: float | None = None, seed: int = 42,
                      stop_rounds: int | None = None, tolerance: float = 0.001, parallelism: int = 8):
    """MLT-01/03/21: fit the first ``max_models`` candidates (None: all) and the
    registered ones, within ``budget_s`` seconds if given; rank by
    validation RMSE (ties by name).  With ``stop_rounds``, fitting stops after
    that many candidates in a row without a relative gain of ``tolerance``.
    Returns (leaderboard DataFrame, {name: PipelineModel})."""
    spark = train.sparkSession
    cands = _reg_candidates(seed)[:max_models] + list(CUSTOM_MODELS.items())
    tr, va = _prep(train, features, label).cache(), _prep(valid, features, label).cache()

    def fit_one(c):
        name, est = c
        model = Pipeline(stages=[_assembler(features), est.copy()]).fit(tr)
        m = M.regression_metrics(model.transform(va), "label", "prediction").first()  # one row of metrics
        return (name, float(m["rmse"]), float(m["mse"]), float(m["mae"]),
                None if m["rmsle"] is None else float(m["rmsle"]), float(m["mse"]), float(m["r2"])), model

    def stop(results):
        if not stop_rounds:
            return False
        best, since = math.inf, 0
        for row, _m in results:
            if row[1] < best * (1 - tolerance):
                best, since = row[1], 0
            else:
                since += 1
        return since >= stop_rounds

    res = _run_candidates(cands, fit_one, budget_s, 1 if stop_rounds else parallelism, stop)
    tr.unpersist(), va.unpersist()
    lb = spark.createDataFrame([r for r, _ in res], "model_id string, rmse double, mse double, mae double, "
                                                      "rmsle double, mean_residual_deviance double, r2 double")
    return lb.orderBy("rmse", "model_id"), {r[0]: m for r, m in res}


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: narrow columns, which many fits read."""
    from sparktab.session import checkpoint_path
    path = checkpoint_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HALVING_BOARD = ("model_id string, status string, rung int, train_rows bigint, rmse double, mse double, mae double, "
                 "rmsle double, mean_residual_deviance double, r2 double")


def _many(models: dict, df: DataFrame, keep: list[str]) -> DataFrame:
    """Predictions of all models in one pass over ``df``: ``keep`` and a column ``p_<name>`` for each."""
    own = {n: m for n, m in models.items() if isinstance(m, TR.TreesModel)}
    if own:
        df = TR.predict(own, df)
    for name, m in models.items():
        if name in own:
            continue
        if hasattr(m, "predictionCol"):
            df = m.copy({m.predictionCol: f"p_{name}"}).transform(df)
        else:  # a registered pipeline: its own columns go
            df = m.transform(df).select(*df.columns, F.col("prediction").alias(f"p_{name}"))
    return df.select(*keep, *[F.col(f"p_{n}") for n in models])


def _scores(predicted: DataFrame, names: list[str]) -> dict:
    """Regression metrics of every ``p_<name>`` column by one aggregation (a row a model)."""
    long = predicted.select("label", F.explode(F.array(*[
        F.struct(F.lit(n).alias("model_id"), F.col(f"p_{n}").alias("yhat")) for n in names])).alias("_p")).select("label", "_p.*")
    return {r["model_id"]: r for r in M.regression_metrics(long, "label", "yhat", ["model_id"]).collect()}  # a row a model


def family(name: str) -> str:
    """Name of a candidate without its running number."""
    return name.rsplit("_", 1)[0]


class StackedModel:
    """A weighted sum of base models: weights from 0 up, and an intercept."""

    def __init__(self, name: str, assembler, models: dict, weights: dict, intercept: float):
        self.name, self.assembler, self.intercept = name, assembler, intercept
        self.weights = {n: w for n, w in weights.items() if w > 0}
        self.models = {n: models[n] for n in self.weights}

    def prediction(self):
        return sum((F.col(f"p_{n}") * float(w) for n, w in self.weights.items()), F.lit(float(self.intercept)))

    def transform(self, df: DataFrame) -> DataFrame:
        cols = df.columns
        return _many(self.models, self.assembler.transform(df), cols).select(*cols, self.prediction().alias("prediction"))


def _fit_all(cands: list, df: DataFrame, budget_s: float | None, parallelism: int, grower=None, n_rows: int | None = None) -> dict:
    """{name: model} of (name, estimator) pairs on ``features``/``label``.  With a
    ``grower``, the tree candidates are grown together, as one more wave after the others'."""
    own = {n: e for n, e in cands if grower and TR.grows(e)}
    t0 = time.time()
    rest = [(n, e) for n, e in cands if n not in own]
    # what a grower reads is on disk with all its columns: the others' many passes are over their own two
    part = df.select("features", "label").cache() if grower and rest else df
    fitted = dict(_run_candidates(rest, lambda c: (c[0], c[1].copy().fit(part)), budget_s, parallelism)) if rest else {}
    if part is not df:
        part.unpersist()
    if own and (not fitted or budget_s is None or time.time() - t0 <= budget_s):
        fitted |= grower.fit(own, df, n_rows if n_rows is not None else df.count())
    return fitted


def out_of_fold(train: DataFrame, base: dict, fold, folds: int = 3, parallelism: int = 8, grower=None) -> DataFrame:
    """(label, p_<name> for each base): every row is scored by models that did
    not see its fold.  All bases of a fold are fitted at once and score it in
    one pass; no join.  ``base``: {name: estimator} on ``features``/``label``."""
    parts = []
    for f in range(folds):
        rest = train.where(fold != f)
        fitted = _fit_all(list(base.items()), rest, None, parallelism, grower)
        parts.append(_many(fitted, train.where(fold == f), ["label"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nonneg_weights(oof: DataFrame, names: list[str], rounds: int = 20000) -> tuple[dict, float]:
    """Least-squares weights >= 0 and an intercept of out-of-fold predictions.
    Spark sums the products of all columns in one aggregation; the driver
    descends by coordinate on that (models x models) matrix, starting at the
    best single model, so the result is never worse than it on these rows."""
    cols = ["label"] + [f"p_{n}" for n in names]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    centre = oof.agg(*[F.avg(c).alias(c) for c in cols]).first()
    dev = oof.select(*[(F.col(c) - F.lit(float(centre[c]))).alias(f"c{i}") for i, c in enumerate(cols)])
    sums = dev.agg(*[F.avg(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = sums[f"s{i}_{j}"]
    g, b = cov[1:, 1:], cov[1:, 0]
    mean = np.array([centre[c] for c in cols])
    single = 2 * b - np.diag(g)  # variance left by each model alone with weight 1, negated
    w = np.zeros(len(names))
    w[int(np.argmax(single))] = 1.0
    for _ in range(rounds):
        moved = 0.0
        for k in np.flatnonzero(np.diag(g) > 0):
            step = max(0.0, w[k] + (b[k] - g[k] @ w) / g[k, k]) - w[k]
            w[k] += step
            moved = max(moved, abs(step))
        if moved < 1e-10:
            break
    return dict(zip(names, map(float, w))), float(mean[0] - mean[1:] @ w)


def automl_halving(train: DataFrame, valid: DataFrame, features: list[str], label: str, key: str, eta: int = 3,
                   rungs: int = 3, folds: int = 3, ensembles: bool = True, budget_s: float | None = None, seed: int = 42,
                   parallelism: int = 8, together: bool = False):
    """MLT-01/03/04: all candidates, and the registered ones, by successive halving.

    Features are assembled once.  Rung r of ``rungs`` fits on the rows whose
    key hash falls in a share of ``eta ** -(rungs - 1 - r)`` (a smaller share is
    part of the next one), scores all its models over ``valid`` in one pass
    and keeps the best 1/``eta`` (rounded up); the last rung fits on every row.
    The shares are the same at every input size.

    With ``ensembles``, two stacked models join the board: of all models that
    reached the last rung and of the best one of each family (fitted on every
    row).  Their weights are ``nonneg_weights`` of an out-of-fold matrix.

    Returns (leaderboard, {name: model}).  The board has one row a candidate:
    status (``finalist``, ``stopped``, ``ensemble``, ``not_fitted``), the last rung it reached, the rows
    it was fitted on there and its metrics; last rung first, then by RMSE.  A
    model id is in the models if it was fitted on every row.  ``valid`` both
    chooses and scores, so the leader's error on it is a little too good: score
    a third frame for a figure to quote.  Every rung fits its first wave; once
    ``budget_s`` seconds are spent no other wave starts and no ensemble is
    built, and what was never fitted has null metrics.  Rows with a null label
    are left out of both frames; a rung without rows fails.

    ``together`` is for frames that grow with the data: both are written once,
    and the tree candidates of a rung are grown together (``trees.Grower``)
    instead of by a fit each; their models are ``TreesModel``.
    """
    t0 = time.time()
    left = lambda: None if budget_s is None else budget_s - (time.time() - t0)
    spark = train.sparkSession
    cands = dict(_reg_candidates(seed) + list(CUSTOM_MODELS.items()))
    asm = _assembler(features)
    h = key_hash(F.col(key), seed, "md5")
    prep = lambda d: _prep(d, features, label).where("label is not null")
    if together:
        tr = asm.transform(_written(prep(train).select(*features, "label", h.alias("_h")), "automl-train"))
        va = asm.transform(_written(prep(valid).select(*features, "label"), "automl-valid"))
        grower = TR.Grower(tr, features, tr.count(), seed)
    else:
        tr = asm.transform(prep(train)).select("features", "label", h.alias("_h")).cache()
        va = asm.transform(prep(valid)).select("features", "label").cache()
        grower = None
    rows, alive, fitted, n_rows = {}, list(cands), {}, 0
    for r in range(rungs):
        part = tr.where(F.col("_h") < HASH_RANGE // eta ** (rungs - 1 - r))
        n_rows = part.count()
        fitted = _fit_all([(n, cands[n]) for n in alive], part, left(), parallelism, grower, n_rows)
        for n in alive:
            if n not in fitted:
                rows.setdefault(n, ("not_fitted", r, 0, None))
        alive = [n for n in alive if n in fitted]
        got = _scores(_many(fitted, va, ["label"]), alive)
        for n in alive:
            rows[n] = ("finalist" if r == rungs - 1 else "stopped", r, n_rows, got[n])
        alive = sorted(alive, key=lambda n: (got[n]["rmse"], n))
        if r < rungs - 1:
            alive = alive[:-(-len(alive) // eta)]
    stacks = {}
    if ensembles and (budget_s is None or left() > 0):
        best = {}
        for n in sorted([n for n in cands if rows[n][3]], key=lambda n: (-rows[n][1], rows[n][3]["rmse"], n)):
            best.setdefault(family(n), n)
        late = [n for n in best.values() if n not in fitted]
        fitted |= _fit_all([(n, cands[n]) for n in late], tr, None, parallelism, grower, n_rows)
        oof = out_of_fold(tr, {n: cands[n] for n in fitted}, F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(folds)), folds, parallelism, grower).cache()
        for name, of in (("StackedEnsemble_AllModels", alive), ("StackedEnsemble_BestOfFamily", list(best.values()))):
            w, c = nonneg_weights(oof, of)
            stacks[name] = StackedModel(name, asm, fitted, w, c)
        oof.unpersist()
        base = _many(fitted, va, ["label"])
        got = _scores(base.select("label", *[m.prediction().alias(f"p_{n}") for n, m in stacks.items()]), list(stacks))
        rows |= {n: ("ensemble", rungs - 1, n_rows, got[n]) for n in stacks}
    tr.unpersist(), va.unpersist()
    shown = ("rmse", "mse", "mae", "rmsle", "mse", "r2")
    board = spark.createDataFrame([(n, s, r, k, *[m and m[c] for c in shown]) for n, (s, r, k, m) in rows.items()], HALVING_BOARD)
    models = {n: PipelineModel(stages=[asm, m.copy({m.predictionCol: "prediction"}) if hasattr(m, "predictionCol") else m]) for n, m in fitted.items()}
    return board.orderBy(F.desc("rung"), F.asc_nulls_last("rmse"), "model_id"), models | stacks


def automl_classification(train: DataFrame, valid: DataFrame, features: list[str], label: str,
                          max_models: int | None = None, budget_s: float | None = None, seed: int = 42,
                          parallelism: int = 8):
    """MLT-02: classifiers ranked by AUC (desc), then log loss."""
    spark = train.sparkSession
    cands = _cls_candidates(seed)[:max_models] + list(CUSTOM_MODELS.items())
    tr, va = _prep(train, features, label).cache(), _prep(valid, features, label).cache()

    def fit_one(c):
        name, est = c
        model = Pipeline(stages=[_assembler(features), est.copy()]).fit(tr)
        p = model.transform(va).withColumn("p1", vector_to_array("probability")[1])
        # exact ROC AUC (numBins=0: no down-sampling), RDD-based, safe in parallel fits
        auc = BinaryClassificationEvaluator(rawPredictionCol="p1", labelCol="label", metricName="areaUnderROC",
                                            numBins=0).evaluate(p)
        ll = M.log_loss(p, "label", "p1").first()["logloss"]
        acc = p.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        return (name, float(auc), float(ll), float(acc)), model

    res = _run_candidates(cands, fit_one, budget_s, parallelism)
    tr.unpersist(), va.unpersist()
    lb = spark.createDataFrame([r for r, _ in res], "model_id string, auc double, logloss double, accuracy double")
    return lb.orderBy(F.desc("auc"), "logloss", "model_id"), {r[0]: m for r, m in res}


def gbt_early_stopping(train: DataFrame, features: list[str], label: str, valid_flag: str,
                       tol: float = 0.001, max_iter: int = 100, seed: int = 42) -> PipelineModel:
    """MLT-21: GBT with a validation indicator column and tolerance."""
    gbt = GBTRegressor(maxIter=max_iter, validationIndicatorCol=valid_flag, validationTol=tol, seed=seed)
    d = _prep(train, features, label)
    return Pipeline(stages=[_assembler(features), gbt]).fit(d)


def kmeans(df: DataFrame, features: list[str], k: int = 4, seed: int = 42) -> PipelineModel:
    """MLT-06."""
    return Pipeline(stages=[_assembler(features), KMeans(k=k, seed=seed)]).fit(df)


def save_model(model: PipelineModel, path: str) -> None:
    """MLT-16."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importance_frame(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """MLT-15 / VIZ-07: (feature, importance) of the last stage, descending."""
    pairs = M.feature_importance(model.stages[-1], features)
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# ---------------------------------------------------------------- isolation forest
def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a BST of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


NODE_SCHEMA = "tree int, node int, feat int, thresh double, left int, right int, size long"


BLOCK = 10_000  # rows that walk together (a batch of Arrow): their columns stay in a core's cache
TABLED = 6  # steps by table: 2^6 ends, a bit of a word each
_BRUIJN = np.uint64(0x03F79D71B4CB0A89)  # times 1 << i, its upper 6 bits differ for every i


class _Walk:
    """Steps of rows down many trees, given as (feat, thresh, left, right) by
    node, feat or left below 0 at a leaf.

    A row's value in a feature is placed once among that feature's cuts of all
    trees.  A table by place then holds, for each tree, the ends of the first
    ``TABLED`` steps that this value leaves open, as bits; all features
    together leave one.  Further steps are taken one by one."""

    def __init__(self, trees: list, steps: int):
        k = 1 + max((int(feat.max()) for feat, *_ in trees), default=-1)
        inner = [self._inner(*tree, min(steps, TABLED)) for tree in trees]
        self.cuts = [np.unique([c for splits, _ in inner for f, c, *_ in splits if f == i]) for i in range(k)]
        self.steps, self.trees = max(0, steps - TABLED), []
        for (feat, thresh, left, right), (splits, ends) in zip(trees, inner):
            by = np.zeros(64, np.int64)
            by[(np.uint64(1) << np.arange(len(ends), dtype=np.uint64)) * _BRUIJN >> np.uint64(58)] = ends
            node = np.arange(len(feat))
            leaf = (feat < 0) | (left < 0)
            kids = np.stack([np.where(leaf, node, left), np.where(leaf, node, right)], 1).ravel()
            self.trees.append(([(i, self._open(i, splits, len(ends))) for i in sorted({f for f, *_ in splits})], by,
                               np.where(leaf, 0, feat).astype(np.int64) * BLOCK, np.where(leaf, np.nan, thresh), kids))

    @staticmethod
    def _inner(feat, thresh, left, right, steps: int) -> tuple[list, list]:
        """Splits (feature, cut, first end of the left, of the right, end) of the first steps, and the nodes they end on, from the left."""
        splits, ends = [], []

        def down(i: int, depth: int) -> None:
            if depth == steps or feat[i] < 0 or left[i] < 0:
                ends.append(i)
                return
            a = len(ends)
            down(int(left[i]), depth + 1)
            b = len(ends)
            down(int(right[i]), depth + 1)
            splits.append((int(feat[i]), float(thresh[i]), a, b, len(ends)))

        down(0, 0)
        return splits, ends

    def _open(self, feature: int, splits: list, ends: int) -> np.ndarray:
        cuts, every = self.cuts[feature], (1 << ends) - 1
        up, down = np.full(len(cuts) + 1, every, np.uint64), np.full(len(cuts) + 1, every, np.uint64)
        for f, c, a, b, z in splits:
            if f == feature:
                at = int(np.searchsorted(cuts, c))
                up[at + 1] &= np.uint64(every ^ ((1 << b) - (1 << a)))  # at or past the cut: not to the left
                down[at] &= np.uint64(every ^ ((1 << z) - (1 << b)))
        return np.bitwise_and.accumulate(up) & np.bitwise_and.accumulate(down[::-1])[::-1]

    def nodes(self, columns: list[np.ndarray]):
        """The node of each row in each tree, a tree at a time, of ``BLOCK``
        rows at most; a missing value goes right."""
        n = len(columns[0])
        values = np.empty((len(columns), BLOCK))
        for i, c in enumerate(columns):
            values[i, :n] = np.where(np.isnan(c), np.inf, c)
        place = [np.searchsorted(cuts, values[i, :n], "right") for i, cuts in enumerate(self.cuts)]
        flat, row = values.ravel(), np.arange(n)
        for tables, ends, column, thresh, kids in self.trees:
            if tables:
                (i, table), *more = tables
                bit = table.take(place[i], mode="clip")
                for i, table in more:
                    bit &= table.take(place[i], mode="clip")
                bit *= _BRUIJN
                bit >>= np.uint64(58)
                node = ends.take(bit.view(np.int64), mode="clip")
            else:
                node = np.zeros(n, np.int64)
            for _ in range(self.steps):
                at = column.take(node, mode="clip")
                at += row
                right = flat.take(at, mode="clip") >= thresh.take(node, mode="clip")
                node += node
                node += right
                node = kids.take(node, mode="clip")
            yield node


class _Forest:
    """Trees under growth as complete binary arrays: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, n_trees: int, max_depth: int):
        nodes = 2 ** (max_depth + 1) - 1
        self.feat = np.full((n_trees, nodes), -1, np.int32)
        self.thresh = np.zeros((n_trees, nodes))
        self.size = np.zeros((n_trees, nodes), np.int64)

    def walk(self, level: int) -> _Walk:
        """The way to the nodes that rows stand on after ``level`` steps; a row
        that met a leaf before stays there."""
        i = np.arange(self.feat.shape[1])
        return _Walk([(f, t, 2 * i + 1, 2 * i + 2) for f, t in zip(self.feat, self.thresh)], level)

    def frame(self) -> pd.DataFrame:
        """NODE_SCHEMA rows; children come after their parent."""
        out = []
        for t in range(len(self.feat)):
            there = np.flatnonzero(self.size[t])
            place = np.full(2 * self.feat.shape[1] + 2, -1, np.int32)
            place[there] = np.arange(len(there))
            split = self.feat[t, there] >= 0
            # a child that no sampled row reached is a leaf of size 0: it needs a node too
            missing = [c for i in there[split] for c in (2 * i + 1, 2 * i + 2) if place[c] < 0]
            place[missing] = len(there) + np.arange(len(missing))
            all_nodes = np.concatenate([there, np.array(missing, np.int64)])
            f = np.where(np.isin(all_nodes, there), self.feat[t, all_nodes], -1)
            out.append(pd.DataFrame({"tree": np.int32(t), "node": np.arange(len(all_nodes), dtype=np.int32), "feat": f.astype(np.int32),
                                     "thresh": self.thresh[t, all_nodes], "left": np.where(f >= 0, place[2 * all_nodes + 1], -1).astype(np.int32),
                                     "right": np.where(f >= 0, place[2 * all_nodes + 2], -1).astype(np.int32), "size": self.size[t, all_nodes]}))
        return pd.concat(out, ignore_index=True)


class IsolationForestModel:
    def __init__(self, features, nodes: pd.DataFrame, psi: float, max_depth: int):
        self.features, self.nodes, self.psi, self.max_depth = features, nodes, psi, max_depth

    def save(self, spark: SparkSession, path: str) -> None:
        meta = pd.DataFrame({"tree": [-1], "node": [-1], "feat": [-1], "thresh": [self.psi], "left": [self.max_depth],
                             "right": [-1], "size": [0]})
        df = pd.concat([self.nodes, meta]).astype({"tree": "int32", "node": "int32", "feat": "int32",
                                                   "left": "int32", "right": "int32", "size": "int64"})
        spark.createDataFrame(df, NODE_SCHEMA).write.mode("overwrite").parquet(path + "/nodes")
        spark.createDataFrame([(",".join(self.features),)], "features string").write.mode("overwrite").parquet(path + "/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForestModel":
        nodes = spark.read.parquet(path + "/nodes").toPandas()  # bounded: n_trees * 2^(depth+1) rows
        feats = spark.read.parquet(path + "/features").first()["features"].split(",")
        meta = nodes[nodes["tree"] == -1].iloc[0]
        return IsolationForestModel(feats, nodes[nodes["tree"] >= 0].reset_index(drop=True),
                                    float(meta["thresh"]), int(meta["left"]))

    def transform(self, df: DataFrame, out: str = "anomaly_score", spread: list[str] | None = None) -> DataFrame:
        """Score every row: s = 2^(-E[h(x)] / c(psi)); high = anomalous.  Only the
        features go through Python, and streams are scored alike.  ``spread``
        names key columns by which a batch frame is dealt to all tasks first."""
        if spread and not df.isStreaming:
            df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *spread)
        feats, max_depth = self.features, self.max_depth
        trees, paths, steps = [], [], 0
        for _t, g in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            left, right = g["left"].to_numpy(), g["right"].to_numpy()
            size = g["size"].to_numpy()
            # children are created after their parent, so one pass in index order gives depths
            depth = np.zeros(len(g))
            for i in range(len(g)):
                if left[i] >= 0:
                    depth[left[i]] = depth[i] + 1
                    depth[right[i]] = depth[i] + 1
            path_len = depth + np.array([_c(float(n)) for n in size])  # per node, computed once
            trees.append((g["feat"].to_numpy(), g["thresh"].to_numpy(), left, right))
            paths.append(path_len)
            steps = max(steps, min(int(depth.max()), max_depth + 1))
        cpsi = _c(self.psi)

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            walk = _Walk(trees, steps)
            for pdf in parts:
                total = np.zeros(len(pdf))
                for at in range(0, len(pdf), BLOCK):
                    some = pdf.iloc[at:at + BLOCK]
                    for node, path_len in zip(walk.nodes([some[c].to_numpy(dtype=float) for c in some]), paths):
                        total[at:at + BLOCK] += path_len.take(node, mode="clip")
                yield pd.Series(np.power(2.0, -total / len(trees) / cpsi) if cpsi > 0 else np.full(len(pdf), 0.5))

        return df.withColumn(out, score(F.struct(*[F.col(c).cast("double").alias(c) for c in feats])))


def fit_isolation_forest(df: DataFrame, features: list[str], key_cols: list[str], n_trees: int = 100,
                         sample_rate: float = 0.8, max_depth: int = 8, seed: int = 42) -> IsolationForestModel:
    """MLT-05: all trees grow together, a level at a time.

    Tree t takes the rows whose hash of (key, t) falls below ``sample_rate``,
    at every size of the input; null features are missing values.  A level is
    one aggregation over (tree, node): least and greatest value of each
    feature, combined in each task, so a task sends at most ``n_trees`` *
    2^level rows and no tree or node is a group of rows.  The driver receives
    those bounds (the size of the model) and draws each node's feature and cut
    from (seed, tree, node), so the model does not depend on the partitioning
    if the keys are unique.  A last aggregation counts the rows on each leaf."""
    from sparktab.session import checkpoint_path
    spark = df.sparkSession
    keys = F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed))
    k = len(features)
    values, least, most, words = ([f"{c}{i}" for i in range(n)] for c, n in (("x", k), ("lo", k), ("hi", k), ("m", -(-n_trees // 64))))
    below = np.uint64(min(1.0, sample_rate) * (2 ** 64 - 1024))

    def members(batches):
        """A row for each block of rows: a column's values as bytes, and the key's
        hash as words with a bit for each tree that takes the row."""
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            key = batch.column(0).to_numpy().view(np.uint64)
            taken = np.zeros((len(words), len(key)), np.uint64)
            for t in range(n_trees):
                h = key ^ np.uint64(t * 0x9E3779B97F4A7C15 % 2 ** 64)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                taken[t // 64] |= (h ^ (h >> np.uint64(31)) < below).astype(np.uint64) << np.uint64(t % 64)
            held = [*(c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]), *taken]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in held], names=[*values, *words])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = checkpoint_path(spark, "forest-rows")
    # narrow, dealt by the key's hash and written once in blocks, which pass through the JVM as they are: every level reads
    # them again; small row groups, as a reader holds a whole one
    df.select(keys.alias("_h"), *[F.col(c).cast("double").alias(v) for c, v in zip(features, values)]).repartition(parts, "_h").mapInArrow(
        members, ", ".join(f"{c} binary" for c in values + words)).write.option("parquet.block.size", 16 << 20).parquet(path)
    rows = spark.read.parquet(path)
    forest = _Forest(n_trees, max_depth)

    def walked(batches, walk):
        """(values, tree, whether it takes the row, node) of each block of rows and tree."""
        for batch in batches:
            for block in zip(*batch.columns):
                x = [np.frombuffer(c.as_buffer(), np.float64) for c in block[:k]]
                taken = [np.frombuffer(c.as_buffer(), np.uint64) for c in block[k:]]
                for t, node in enumerate(walk.nodes(x)):
                    yield x, t, taken[t // 64] & np.uint64(1 << t % 64) != 0, node

    def bounds(level: int):
        first, width = 2 ** level - 1, 2 ** level

        def find(batches):
            early = (forest.feat[:, :first] < 0).any(1)  # trees with a leaf above this level
            # over the whole task; the last place is for rows that do not count, and nothing is past its bounds
            low, high = np.full((n_trees, k, width + 1), np.inf), np.full((n_trees, k, width + 1), -np.inf)
            low[:, :, width], high[:, :, width] = -np.inf, np.inf
            for x, t, mine, node in walked(batches, forest.walk(level)):
                if early[t]:
                    mine &= node >= first
                node -= first
                place = np.where(mine, node, width)
                new = np.zeros(len(place), bool)
                for v, lo, hi in zip(x, low[t], high[t]):  # a missing value is past no bound
                    new |= v < lo.take(place, mode="clip")
                    new |= v > hi.take(place, mode="clip")
                new = np.flatnonzero(new)  # few after the first blocks
                if len(new):
                    place = place[new]
                    for v, lo, hi in zip(x, low[t], high[t]):
                        there = ~np.isnan(v[new])
                        np.minimum.at(lo, place[there], v[new][there])
                        np.maximum.at(hi, place[there], v[new][there])
            found = low[:, :, :width] <= high[:, :, :width]
            tree, place = np.nonzero(found.any(1))
            if len(tree):
                none = ~found[tree, :, place].T
                cols = zip([*low[tree, :, place].T, *high[tree, :, place].T], [*none, *none])
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array((place + first).astype(np.int32)),
                                                  *[pa.array(c, mask=m) for c, m in cols]], names=["tree", "node", *least, *most])

        return rows.mapInArrow(find, "tree int, node int" + "".join(f", {c} double" for c in least + most)).groupBy("tree", "node").agg(
            *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])

    def sizes(level: int):
        def count(batches):
            others = 2 ** (level + 1)  # the place of rows that do not count
            number = np.zeros((n_trees, others + 1), np.int64)
            for _, t, mine, node in walked(batches, forest.walk(level)):
                number[t] += np.bincount(np.where(mine, node, others), minlength=others + 1)
            tree, node = np.nonzero(number[:, :others])
            if len(tree):
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(number[tree, node])], names=["tree", "node", "n"])

        return rows.mapInArrow(count, "tree int, node int, n bigint").groupBy("tree", "node").agg(F.sum("n").alias("n"))

    level = 0
    while level < max_depth:
        split = 0
        for r in bounds(level).collect():  # at most n_trees * 2^level rows
            t, i = r["tree"], r["node"]
            can = [f for f in range(k) if r[f"lo{f}"] is not None and r[f"hi{f}"] > r[f"lo{f}"]]
            if can:
                rng = np.random.default_rng([seed, t, i])
                f = can[int(rng.integers(len(can)))]
                forest.feat[t, i], forest.thresh[t, i] = f, rng.uniform(r[f"lo{f}"], r[f"hi{f}"])
                split += 1
        if not split:
            break
        level += 1
    for r in sizes(level).collect():
        forest.size[r["tree"], r["node"]] = r["n"]
    for i in range(2 ** level - 2, -1, -1):  # the nodes above the leaves
        forest.size[:, i] += forest.size[:, 2 * i + 1] + forest.size[:, 2 * i + 2]
    nodes = forest.frame()
    return IsolationForestModel(features, nodes, float(forest.size[:, 0].mean()), max_depth)
