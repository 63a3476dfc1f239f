"""Halving, ensembles, the fallback chain and chunked text aggregates against plain Python."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from sparktab.operators import forecast as FC
from sparktab.operators import ml as ML
from sparktab.operators import trees as TR
from sparktab.operators.sequence import ordered_text


@pytest.fixture(scope="module")
def planted(spark):
    """y has a linear part and a step: no single family fits both."""
    rng = np.random.default_rng(5)
    x, z = rng.uniform(-1, 1, (2, 1500))
    y = 5 * x + np.where(z > 0.2, 4.0, 0.0) + rng.normal(0, 0.1, 1500)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    d = spark.createDataFrame(rows + [(9001, 0.0, 0.0, None)], "id long, x double, z double, y double")
    return d.where("id % 5 > 0"), d.where("id % 5 = 0")


NAMES = ["GLM_1", "GLM_2", "Tree_1", "Tree_2", "Tree_3"]


@pytest.fixture
def five(spark, monkeypatch):
    trees = [DecisionTreeRegressor(maxDepth=k, seed=1) for k in (3, 1, 2)]
    monkeypatch.setattr(ML, "_reg_candidates", lambda seed: list(zip(NAMES, [LinearRegression(), LinearRegression(regParam=5.0), *trees])))


def test_halving_and_ensembles(spark, planted, five):
    train, test = planted
    board, models = ML.automl_halving(train, test, ["x", "z"], "y", "id", eta=2, rungs=2)
    rows = {r.model_id: r for r in board.collect()}
    assert set(rows) == set(NAMES) | {"StackedEnsemble_AllModels", "StackedEnsemble_BestOfFamily"}
    assert sorted(r.status for r in rows.values()).count("finalist") == 3 and sum(r.status == "stopped" for r in rows.values()) == 2
    assert {r.train_rows for r in rows.values() if r.rung == 1} == {1200}  # the row without a label is left out
    best = min(r.rmse for r in rows.values() if r.status == "finalist")
    for n in ("StackedEnsemble_AllModels", "StackedEnsemble_BestOfFamily"):
        m = models[n]
        assert rows[n].rmse <= best and all(w > 0 for w in m.weights.values())
        p = m.transform(test.where("y is not null")).select("y", "prediction").toPandas()
        assert math.isclose(rows[n].rmse, float(np.sqrt(((p.y - p.prediction) ** 2).mean())), rel_tol=1e-9)
    assert {ML.family(n) for n in models["StackedEnsemble_BestOfFamily"].weights} == {"GLM", "Tree"}


def test_halving_spent_budget(spark, planted, five):
    train, test = planted
    board, models = ML.automl_halving(train, test, ["x", "z"], "y", "id", eta=2, rungs=2, budget_s=0, parallelism=2)
    rows = board.collect()
    assert len(rows) == 5 and not any(isinstance(m, ML.StackedModel) for m in models.values())
    assert {r.model_id for r in rows if r.status == "not_fitted"} == {"Tree_1", "Tree_2", "Tree_3"}
    assert all((r.rmse is None) == (r.status == "not_fitted") for r in rows) and rows[0].status == "finalist"


def test_registered_pipeline(spark, planted, five):
    train, test = planted
    ML.register_custom_model("Own", Pipeline(stages=[DecisionTreeRegressor(maxDepth=8, seed=1)]))
    try:
        board, models = ML.automl_halving(train, test, ["x", "z"], "y", "id", eta=2, rungs=1)
    finally:
        ML.CUSTOM_MODELS.pop("Own")
    rows = {r.model_id: r.rmse for r in board.collect()}
    assert len(rows) == 8 and models["Own"].transform(test).where("prediction is null").count() == 0
    p = models["Own"].transform(test.where("y is not null")).select("y", "prediction").toPandas()
    assert math.isclose(rows["Own"], float(np.sqrt(((p.y - p.prediction) ** 2).mean())), rel_tol=1e-9)


@pytest.fixture(scope="module")
def grid(spark):
    """Few and many values, a missing one in some rows, a feature without any spread."""
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=4000), rng.integers(0, 7, 4000), rng.integers(0, 60, 4000)
    y = 100 + 3 * a + np.where(b > 3, c, -a * a) + rng.normal(size=4000)
    rows = [(i, float(p), int(q), float(r), 1.0, float(t)) for i, (p, q, r, t) in enumerate(zip(a, b, c, y))]
    d = spark.createDataFrame(rows, "_h long, a double, b int, c double, k double, label double").repartition(6)
    return ML._assembler(["a", "b", "c", "k"]).transform(d.withColumn("c", F.when(F.col("_h") % 50 > 0, F.col("c")))).cache()


def test_grown_trees_are_those_of_single_fits(spark, grid, monkeypatch):
    monkeypatch.setattr(TR, "BLOCK", 700)
    cands = {"deep": DecisionTreeRegressor(maxDepth=9), "flat": DecisionTreeRegressor(maxDepth=2), "long": GBTRegressor(maxIter=6, maxDepth=4),
             "short": GBTRegressor(maxIter=3, maxDepth=4, seed=5), "fast": GBTRegressor(maxIter=4, maxDepth=3, stepSize=0.3)}
    full = grid.where("c is not null")  # pyspark.ml orders a missing value by its sign bit
    n = full.count()
    grown = TR.Grower(full, ["a", "b", "c", "k"], n).fit(cands, full, n)
    rows = TR.predict(grown, full).toPandas().set_index("_h").sort_index()
    for name, e in cands.items():
        alone = e.fit(full).transform(full).toPandas().set_index("_h").sort_index()
        assert np.allclose(rows[f"p_{name}"], alone.prediction, rtol=0, atol=1e-8), name
    assert grown["short"].trees[2] is grown["long"].trees[2]  # grown once


@pytest.mark.parametrize("direct", (TR.DIRECT_BYTES, 0))
def test_grown_forest(spark, grid, monkeypatch, direct):
    """The same whatever the partitions, with missing values; as good as the forest of pyspark.ml without them."""
    monkeypatch.setattr(TR, "DIRECT_BYTES", direct)
    e = {"f": RandomForestRegressor(numTrees=30, maxDepth=8, seed=4)}
    got = []
    for d in (grid, grid.repartition(3)):
        m = TR.Grower(d, ["a", "b", "c", "k"], 4000).fit(e, d, 4000)["f"]
        assert len(m.trees) == 30
        got.append(m.transform(d).toPandas().set_index("_h").sort_index())
    assert np.allclose(got[0].prediction, got[1].prediction, rtol=0, atol=1e-6)
    mse = lambda p: float(((p.label - p.prediction) ** 2).mean())
    full = grid.where("c is not null")
    n = full.count()
    m = TR.Grower(full, ["a", "b", "c", "k"], n).fit(e, full, n)["f"]
    assert mse(m.transform(full).toPandas()) < 1.3 * mse(e["f"].fit(full).transform(full).toPandas())


def test_grows_only_what_it_knows(spark):
    assert TR.grows(GBTRegressor(maxDepth=3, stepSize=0.2)) and TR.grows(RandomForestRegressor(numTrees=5)) and not TR.grows(LinearRegression())
    assert not TR.grows(DecisionTreeRegressor(minInstancesPerNode=5)) and not TR.grows(GBTRegressor(lossType="absolute"))
    assert not TR.grows(RandomForestRegressor(subsamplingRate=0.5))


def test_halving_with_trees_grown_together(spark, planted, five):
    train, test = planted
    apart, _ = ML.automl_halving(train, test, ["x", "z"], "y", "id", eta=2, rungs=2)
    board, models = ML.automl_halving(train, test, ["x", "z"], "y", "id", eta=2, rungs=2, together=True)
    a, b = ({r.model_id: r for r in d.collect()} for d in (apart, board))
    assert set(a) == set(b) and any(isinstance(m.stages[-1], TR.TreesModel) for m in models.values() if not isinstance(m, ML.StackedModel))
    for n in a:
        # on all rows the cuts are those of a single fit; parts of them share these
        assert a[n][1:4] == b[n][1:4] and math.isclose(a[n].rmse, b[n].rmse, rel_tol=1e-6 if a[n].status == "finalist" else 0.03), n
    for n, m in models.items():
        p = m.transform(test.where("y is not null")).select("y", "prediction").toPandas()
        assert math.isclose(b[n].rmse, float(np.sqrt(((p.y - p.prediction) ** 2).mean())), rel_tol=1e-9)


def test_weights_match_a_plain_fit_and_beat_single_models(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(0, 1, (400, 3)) + 100
    y = 2.0 * p[:, 0] + 0.5 * p[:, 1] - 1.0 * p[:, 2] + 3 + rng.normal(0, 0.01, 400)
    oof = spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, p)], "label double, p_a double, p_b double, p_c double")
    w, c = ML.nonneg_weights(oof, ["a", "b", "c"])
    # the third weight would be negative, so it is 0 and the others are the plain fit without it
    plain, *_ = np.linalg.lstsq(np.column_stack([p[:, :2], np.ones(400)]), y, rcond=None)
    assert w["c"] == 0 and np.allclose([w["a"], w["b"], c], plain, atol=1e-4)
    err = lambda e: float((e ** 2).mean())
    assert err(y - (w["a"] * p[:, 0] + w["b"] * p[:, 1] + c)) <= min(err(y - p[:, i] - (y - p[:, i]).mean()) for i in range(3))


def test_fallback_chain(spark, planted):
    train, test = planted
    d = ML._prep(train, ["x", "z"], "y").where("label is not null")
    strict = Pipeline(stages=[VectorAssembler(inputCols=["x", "z"], outputCol="features", handleInvalid="error"), LinearRegression()]).fit(d)
    lacking = Pipeline(stages=[ML._assembler(["x", "z", "w"]), LinearRegression()]).fit(d.withColumn("w", F.lit(1.0)))
    trained = []

    def small():
        trained.append(1)
        return Pipeline(stages=[ML._assembler(["x", "z"]), DecisionTreeRegressor(maxDepth=2)]).fit(d)

    def broken():
        raise ValueError("no data")

    holed = test.withColumn("z", F.when(F.col("id") != 1495, F.col("z")))
    chain = [("strict", strict), ("lacking", lacking), ("broken", broken), ("small", small)]
    for probe, step in ((0, "run"), (1000, "probe")):
        out, used, tried = FC.score_with_fallback(holed, chain, probe_rows=probe)
        assert used == "small" and out.count() == test.count()
        assert [(r.model, r.step, r.failed) for r in tried.orderBy("position").collect()] == [
            ("strict", step, True), ("lacking", "analysis", True), ("broken", "train", True), ("small", "done", False)]
    trained.clear()
    out, used, _ = FC.score_with_fallback(test, chain)
    assert used == "strict" and not trained  # nothing is trained that the chain doesn't reach
    assert FC.score_with_fallback(holed.limit(0), chain)[1] == "strict"
    with pytest.raises(RuntimeError, match="strict at run.*lacking at analysis"):
        FC.score_with_fallback(holed, chain[:2], probe_rows=0)


def test_ordered_text_over_many_chunks(spark):
    rows = [("hot", i // 3, f"t{i:04d}") for i in range(2000)] + [("one", 1, "a"), (None, 2, "y"), (None, 1, "x"), ("none", 1, None),
                                                                    ("gap", 1, "p"), ("gap", 2, None), ("gap", 3, "q"), ("tie", 1, "b"), ("tie", 1, "a"), ("tie", 1, "a"), ("empty", 1, "")]
    d = spark.createDataFrame(rows, "k string, o int, t string").repartition(16)
    got = {r.k: (r.n, r.text) for r in ordered_text(d, ["k"], ["o"], "t", ",", chunk=7).collect()}
    assert got == {"hot": (2000, ",".join(f"t{i:04d}" for i in range(2000))), "one": (1, "a"), None: (2, "x,y"), "none": (0, None),
                   "gap": (2, "p,q"), "tie": (3, "a,a,b"), "empty": (1, "")}
    assert ordered_text(d.limit(0), ["k"], ["o"], "t").count() == 0


def test_line_frame_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    """One file of one row group is one task of a scan; the frame has as many tasks as its rows ask for."""
    from sparktab.plans import q_models as Q
    monkeypatch.setattr(Q, "LINES_A_TASK", 50)
    day = F.timestamp_seconds(F.lit(1_700_000_000)).cast("timestamp_ntz")
    spark.range(2000).coalesce(1).select(
        F.floor(F.col("id") / 4).alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
        F.when(F.col("id") % 10 > 0, F.col("id") % 230).alias("l_partkey"), F.lit(1.0).alias("l_quantity"), F.lit(0.1).alias("l_discount"),
        F.lit(0.0).alias("l_tax"), day.alias("l_shipdate"), F.col("id").cast("double").alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(200).coalesce(1).select(F.col("id").alias("p_partkey"), F.lit(9.0).alias("p_retailprice"), F.lit(3).alias("p_size")) \
        .write.parquet(f"{tmp_path}/part.parquet")
    d = Q._line_frame(spark, str(tmp_path))
    held = d.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 20 and max(r["count"] for r in held) < 200
    want = sorted(f"{i // 4}-{i % 4}" for i in range(2000) if i % 10 and i % 230 < 200)
    assert sorted(r["line"] for r in d.select("line").collect()) == want
