"""Property and golden checks for operators without a SQL oracle."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_golden_calendar_row(spark):
    from sparktab.operators.features import calendar_features
    df = spark.createDataFrame([(dt.date(2025, 8, 8),)], "fecha date")
    r = calendar_features(df, "fecha").first()
    assert (r["fecha__year"], r["fecha__month"], r["fecha__day"], r["fecha__dayofweek"]) == (2025, 8, 8, 4)
    assert (r["fecha__is_weekend"], r["fecha__quarter"], r["fecha__dayofyear"], r["fecha__weekofyear"]) == (0, 3, 220, 32)
    assert (r["fecha__is_month_start"], r["fecha__is_month_end"]) == (0, 0)


def test_localised_dates_round_trip(spark):
    from sparktab.functions.dates import format_localised, parse_localised
    days = spark.range(0, 4 * 366).select(F.date_add(F.lit("2022-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    r = days.select("d", parse_localised(format_localised(F.col("d"))).alias("back"))
    assert r.where(F.col("d") != F.col("back")).count() == 0
    strict = days.select(parse_localised(format_localised(F.col("d")), strict=True).alias("b"), F.month("d").alias("m"))
    # the strict parser misses exactly the September dates ('sept.')
    assert strict.where(F.col("b").isNull() & (F.col("m") != 9)).count() == 0
    assert strict.where(F.col("b").isNotNull() & (F.col("m") == 9)).count() == 0


def test_european_numbers_round_trip(spark):
    from sparktab.functions.numbers import parse_european, parse_multi_mark
    vals = [0.0, 1.5, 12.34, 999.99, 1000.0, 1234567.89, 8992.62]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    eu = df.select("v", F.translate(F.format_number("v", 2), ",.", ".,").alias("s"))
    assert eu.where(parse_european(F.col("s")) != F.col("v")).count() == 0
    us = df.select("v", F.format_number("v", 2).alias("s"))
    assert us.where(parse_multi_mark(F.col("s")) != F.col("v")).count() == 0
    bad = spark.createDataFrame([("abc",), ("1,2,3x",)], "s string").select(parse_european(F.col("s")).alias("x"))
    assert bad.where(F.col("x").isNotNull()).count() == 0


def test_seq_number_with_hot_key(spark):
    """One group holds ~60 % of rows: numbering is still exact and contiguous."""
    from sparktab.operators.sequence import seq_lag, seq_number
    df = spark.range(0, 5000).select(F.when(F.col("id") % 5 < 3, F.lit(0)).otherwise(F.col("id") % 7 + 1).alias("g"),
                                     F.col("id"))
    n = seq_number(df, ["g"], ["id"], "rn", num_partitions=6)
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    j = n.join(ref, ["g", "id"])
    assert j.count() == 5000 and j.where(F.col("rn") != F.col("rn2")).count() == 0
    lag = seq_lag(n, ["g"], "rn", ["id"], 1)
    ref_lag = ref.withColumn("prev", F.lag("id").over(Window.partitionBy("g").orderBy("id")))
    jj = lag.join(ref_lag, ["g", "id"])
    assert jj.where(~F.col("id_lag1").eqNullSafe(F.col("prev"))).count() == 0


def test_prefix_sum_and_top_k(spark):
    from sparktab.operators.profile import top_k
    from sparktab.operators.sequence import prefix_sum
    df = spark.range(1, 2001).select(F.col("id").alias("k"), (F.col("id") % 13).alias("v"), (F.col("id") % 3).alias("g"))
    p = prefix_sum(df, ["k"], "v", "cs", num_partitions=5).toPandas().sort_values("k")
    assert (p["cs"].to_numpy() == p["v"].cumsum().to_numpy()).all()
    t = top_k(df, ["g"], [F.desc("v"), F.asc("k")], 4).toPandas()
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), F.asc("k")))) \
            .where("r <= 4").toPandas()
    assert sorted(zip(t["g"], t["k"], t["rank"])) == sorted(zip(ref["g"], ref["k"], ref["r"]))


def test_isolation_forest_separates_planted_outliers(spark):
    import numpy as np
    from sparktab.operators.ml import IsolationForestModel, fit_isolation_forest
    rng = np.random.default_rng(0)
    inl = rng.normal(0, 1, size=(3000, 3))
    out = rng.normal(8, 0.5, size=(30, 3))
    pdf = pd.DataFrame(np.vstack([inl, out]), columns=["a", "b", "c"])
    pdf["id"] = range(len(pdf))
    pdf["is_out"] = [0] * 3000 + [1] * 30
    df = spark.createDataFrame(pdf)
    m = fit_isolation_forest(df, ["a", "b", "c"], ["id"], n_trees=50, max_depth=8)
    s = m.transform(df).toPandas()
    assert s[s.is_out == 1].anomaly_score.min() > s[s.is_out == 0].anomaly_score.quantile(0.95)
    assert s.anomaly_score.between(0, 1).all()
    # every tree was built on the same share of the rows, and the model does not depend on the partitioning
    roots = m.nodes[m.nodes.node == 0]["size"]
    assert len(roots) == 50 and roots.between(0.75 * len(pdf), 0.85 * len(pdf)).all()
    again = fit_isolation_forest(df.repartition(7), ["a", "b", "c"], ["id"], n_trees=50, max_depth=8)
    assert m.nodes.equals(again.nodes)
    # node by node: the rows that reach a node are its size
    inner = m.nodes[m.nodes.left >= 0]
    for t, g in m.nodes.groupby("tree"):
        size = g.set_index("node")["size"]
        i = inner[inner.tree == t]
        assert (size[i.left].to_numpy() + size[i.right].to_numpy() == i["size"].to_numpy()).all()


def test_future_spines(spark):
    from sparktab.operators.forecast import spine
    h = spark.createDataFrame([(dt.date(2025, 8, 7), 1.0)], "d date, value double")
    d = [r["d"] for r in spine(h, "d", [], 30, "D").orderBy("d").collect()]
    assert len(d) == 30 and d[0] == dt.date(2025, 8, 8) and d[-1] == dt.date(2025, 9, 6)
    w = [r["d"] for r in spine(h, "d", [], 5, "W").orderBy("d").collect()]
    assert all(x.weekday() == 0 for x in w) and w[0] >= dt.date(2025, 8, 14)
    m = [r["d"] for r in spine(h, "d", [], 3, "M").orderBy("d").collect()]
    assert m == [dt.date(2025, 9, 30), dt.date(2025, 10, 31), dt.date(2025, 11, 30)]


def test_sql_guard(spark):
    import pytest
    from sparktab.sources.catalog import guard
    assert guard("```sql\nSELECT 1\n```") == "SELECT 1 LIMIT 100"
    assert guard("EXPLAIN SELECT a FROM t LIMIT 5") == "SELECT a FROM t LIMIT 5"
    assert guard("select credit_limit from t") == "select credit_limit from t"  # substring rule, as in the reference
    with pytest.raises(ValueError):
        guard("DELETE FROM t")
    with pytest.raises(ValueError):
        guard("WITH x AS (SELECT 1) SELECT * FROM x")


def test_normalise_literals_many_per_text(spark):
    from sparktab.functions.sqltext import normalise_literals
    t = "[(datetime.datetime(2024, 1, 5), Decimal('1.50')), (datetime.datetime(2023, 11, 30, 7, 5, 9), Decimal('2'))]"
    r = spark.createDataFrame([(t,)], "t string").select(normalise_literals(F.col("t")).alias("n")).first()["n"]
    assert r == "[('2024-01-05T00:00:00', '1.50'), ('2023-11-30T07:05:09', '2')]"


def test_automl_and_save_load(spark):
    from sparktab.plans import q_models as Q
    from sparktab.operators import ml as ML
    from sparktab.session import checkpoint_path
    tr, te = Q._tt(spark, SF_SMALL)
    lb, models = ML.automl_regression(tr, te, Q.FEATURES, "value", max_models=3, budget_s=120)
    p = lb.toPandas()
    assert list(p.rmse) == sorted(p.rmse) and len(p) == 3 and all(math.isfinite(x) for x in p.r2)
    m = models[p.model_id.iloc[0]]
    path = checkpoint_path(spark, "t-model")
    ML.save_model(m, path)
    a = m.transform(te).select("d", "prediction").toPandas().sort_values("d")
    b = ML.load_model(path).transform(te).select("d", "prediction").toPandas().sort_values("d")
    assert (a.prediction.to_numpy() == b.prediction.to_numpy()).all()


def test_stream_sequence_state_equals_batch(spark):
    from sparktab.plans import views as V
    from sparktab.operators import telemetry as T
    from sparktab.plans.q_stream import str_02
    s = str_02(spark, SF_SMALL).toPandas()
    e = V.agent_events(V.tables(spark, SF_SMALL).events)
    ms = T.milestones(e).toPandas()
    got = sorted(zip(s[s.kind == "milestone"].job_id, s[s.kind == "milestone"].position))
    assert got == sorted(zip(ms.job_id, ms.rn))
    from sparktab.operators.sequence import seq_lag, seq_number
    n = seq_number(e.select("job_id", "event_id", "ts", "agent_name"), ["job_id"], ["ts", "event_id"], "rn")
    tr = seq_lag(n, ["job_id"], "rn", ["agent_name"], 1, "_prev")
    tr = tr.where(F.col("agent_name_prev").isNotNull() & (F.col("agent_name_prev") != F.col("agent_name"))).count()
    assert tr == int((s.kind == "transition").sum())


def _events_replay(spark, per_slice):
    from sparktab.session import checkpoint_path
    from sparktab.streaming import streams as ST
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        (F.col("event_id") % 7).alias("job_id"), "event_id", "ts", "event_type", "value",
        F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("agent_name"))
    src = checkpoint_path(spark, "t-replay")
    delay = ST.delay(ST.stage_slices(e.repartition(per_slice), src, "ts", 3))
    return e, src, delay


@pytest.mark.parametrize("per_slice,max_files", [(6, 1), (6, 8), (1, 1)])
def test_streams_equal_batch_for_any_files(spark, per_slice, max_files):
    """Files of a slice are in no order and come in several triggers."""
    from sparktab.streaming import streams as ST
    e, src, delay = _events_replay(spark, per_slice)
    got = ST.windowed_counts(spark, src, e.schema, "ts", "1 hour", delay, ["event_type"], max_files=max_files).toPandas()
    assert got.n.sum() == e.count() and not got.duplicated(["window_start", "event_type"]).any()
    ST.end_of_stream(e, src)
    s = ST.sequence_state(spark, src, e.schema, [(5, "x", 1)], delay, max_files=max_files).toPandas()
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    b = e.select("job_id", F.row_number().over(w).alias("position"), F.lag("agent_name").over(w).alias("from_agent"), F.col("agent_name").alias("to_agent"))
    key = ["job_id", "position", "from_agent", "to_agent"]
    want = b.where("from_agent <> to_agent").select(*key).toPandas()
    assert sorted(map(tuple, s[s.kind == "transition"][key].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
    assert sorted(s[s.kind == "milestone"].job_id) == sorted(r[0] for r in b.where("position = 5").select("job_id").collect())


@pytest.mark.parametrize("bucket_seconds", [60, 86400])
def test_sequence_state_hot_job_one_file_per_trigger(spark, bucket_seconds):
    """A third of all events are of one job; null agents, a null job and
    equal times are there too; files come one by one, unordered in time."""
    from sparktab.session import checkpoint_path
    from sparktab.streaming import streams as ST
    e = spark.range(1500).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 11).cast("long").alias("job_id"),
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor((F.col("id") * 7919 % 1500) / 4) * 37).alias("ts"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("a"), (F.xxhash64("id") % 3).cast("string"))).alias("agent_name"))
    src = checkpoint_path(spark, "t-hot-job")
    delay = ST.delay(ST.stage_slices(e.repartition(2), src, "ts", 2))
    ST.end_of_stream(e, src)
    before = spark.conf.get(ST.PROVIDER_KEY, None)
    s = ST.sequence_state(spark, src, e.schema, [(5, "x", 1), (400, "y", 2)], delay, max_files=1, bucket_seconds=bucket_seconds).toPandas()
    assert spark.conf.get(ST.PROVIDER_KEY, None) == before
    want, marks = [], []
    rows = sorted(e.collect(), key=lambda r: (r.ts, r.event_id))
    for job in {r.job_id for r in rows}:
        mine = [r.agent_name for r in rows if r.job_id == job]
        want += [(job, i + 2, a, b) for i, (a, b) in enumerate(zip(mine, mine[1:])) if a and b and a != b]
        marks += [(job, n) for n in (5, 400) if len(mine) >= n]

    def jobs(frame, *cols):
        return sorted(((None if r[0] != r[0] else int(r[0]), *r[1:]) for r in frame[list(cols)].itertuples(index=False)), key=repr)
    assert jobs(s[s.kind == "transition"], "job_id", "position", "from_agent", "to_agent") == sorted(want, key=repr)
    assert jobs(s[s.kind == "milestone"], "job_id", "position") == sorted(marks, key=repr)


def test_sequence_state_default_bucket_spans_the_delay(spark, monkeypatch):
    """A job's events lie hours apart: one timer a delay, not one an hour.  Chunks
    of one hot job are merged in order, also at equal times and missing ids."""
    from sparktab.session import checkpoint_path
    from sparktab.streaming import streams as ST
    spans = []

    class Seen(ST.JobSequence):
        def __init__(self, milestones, bucket_ms):
            spans.append(bucket_ms)
            super().__init__(milestones, bucket_ms)

    monkeypatch.setattr(ST, "JobSequence", Seen)
    e = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id") % 7).cast("long").alias("job_id"),
        F.when(F.col("id") % 97 != 5, F.col("id")).alias("event_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor((F.col("id") * 1009 % 3000) / 2) * 1700).alias("ts"),
        F.concat(F.lit("a"), (F.xxhash64("id") % 3).cast("string")).alias("agent_name"))
    src = checkpoint_path(spark, "t-wide-bucket")
    delay = ST.delay(ST.stage_slices(e.repartition(3), src, "ts", 2))
    ST.end_of_stream(e, src)
    e.limit(5).withColumn("ts", F.lit(None).cast("timestamp")).coalesce(1).write.parquet(f"{src}/slice=untimed")  # left out
    s = ST.sequence_state(spark, src, e.schema, [], delay, max_files=2).toPandas()
    assert spans == [int(delay.split()[0]) * 1000]
    want, rows = [], sorted(e.collect(), key=lambda r: (r.ts, r.event_id is None, r.event_id or 0))
    for job in {r.job_id for r in rows}:
        mine = [r.agent_name for r in rows if r.job_id == job]
        want += [(job, i + 2, a, b) for i, (a, b) in enumerate(zip(mine, mine[1:])) if a != b]
    assert sorted(s[["job_id", "position", "from_agent", "to_agent"]].itertuples(index=False, name=None)) == sorted(want)


def test_late_rows_are_reported(spark):
    from sparktab.streaming import streams as ST
    e, src, delay = _events_replay(spark, 1)
    e.orderBy("ts").limit(2).coalesce(1).write.parquet(f"{src}/slice=late")
    with pytest.warns(UserWarning, match="later than the watermark"):
        got = ST.windowed_counts(spark, src, e.schema, "ts", "1 hour", delay, ["event_type"], max_files=1).toPandas()
    assert got.n.sum() == e.count()


def test_metrics_and_profile_without_values(spark):
    """One class, a constant target, an exact naive forecast, a last actual of
    0, a column without values and an empty table: null or 0, no error."""
    from sparktab.operators import forecast as FC, models as M, profile as P
    one = spark.createDataFrame([(1, 0.3, 5.0, 4.0), (1, 0.6, 5.0, 6.0)], "y int, p double, t double, f double")
    assert M.auc(one, "y", "p").first()["auc"] is None
    r = M.regression_metrics(one, "t", "f").first()
    assert r["r2"] is None and r["rmse"] == 1.0
    assert M.forecast_metrics(one.withColumn("prev", F.lit(1.0)), "t", "f", "t", "prev").first()["mase"] is None
    h = spark.createDataFrame([("2024-01-01", 0.0)], "d string, value double")
    f = spark.createDataFrame([("2024-01-02", 3.0)], "d string, prediction double")
    assert FC.change_pct(h, f).first()["change_pct"] is None
    t = spark.createDataFrame([("2024-01-05", None), (None, None), (None, None), (None, None)], "a string, b string")
    got = {x["column_name"]: (x["ratio"], x["is_date"]) for x in P.date_candidates(t).collect()}
    assert got == {"a": (0.25, False), "b": (0.0, False)}
    assert {x["column_name"]: x["is_mixed"] for x in P.mixed_type(t).collect()} == {"a": False, "b": False}
    assert [x["ratio"] for x in P.date_candidates(t.limit(0)).collect()] == [0.0, 0.0]
    assert [(x["column_name"], x["n_rows"], x["n_unique"]) for x in P.profile(t.limit(0)).orderBy("position").collect()] == [("a", 0, 0), ("b", 0, 0)]


def test_isolation_forest_scores_a_stream(spark):
    from sparktab.operators import ml as ML
    from sparktab.streaming import streams as ST
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    model = ML.fit_isolation_forest(li, ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"], n_trees=10)
    got = ST.score_stream(spark, f"{SF_SMALL}/lineitem*", li.schema, model)
    a = sorted(map(tuple, got.select("l_orderkey", "l_linenumber", "anomaly_score").collect()))
    assert a == sorted(map(tuple, model.transform(li).select("l_orderkey", "l_linenumber", "anomaly_score").collect()))


def test_edits_check_positions_and_lose_no_value(spark):
    from sparktab.operators import clean as C
    df = spark.createDataFrame([(0, 1, "a", dt.date(2024, 1, 1)), (1, 2, "b", None)], "_row bigint, n int, s string, d date")
    for bad in (-1, 2):
        with pytest.raises(IndexError):
            C.delete_row(df, bad)
        with pytest.raises(IndexError):
            C.edit_cell(df, bad, "n", "1")
    with pytest.raises(IndexError):
        C.delete_row(df.limit(0), 0)
    assert [C.typed_literal(v) for v in ("12", "-3", "1.5", ".5", "1.2.3", "1e5", "nan", " 7 ", "1_000", "")] == \
        [12, -3.0, 1.5, 0.5, "1.2.3", "1e5", "nan", " 7 ", "1_000", ""]
    cell = lambda c, v: C.edit_cell(df, 1, c, v).orderBy("_row").select(c)
    assert cell("n", "7").dtypes == [("n", "int")] and [r[0] for r in cell("n", "7").collect()] == [1, 7]
    assert [r[0] for r in cell("n", "1.5").collect()] == [1.0, 1.5]
    assert [r[0] for r in cell("n", "99999999999").collect()] == [1.0, 99999999999.0]
    assert [r[0] for r in cell("n", "1e5").collect()] == ["1", "1e5"]
    assert [r[0] for r in cell("d", "2024-02-03").collect()] == [dt.date(2024, 1, 1), dt.date(2024, 2, 3)]
    assert [r[0] for r in cell("d", "soon").collect()] == ["2024-01-01", "soon"]
    assert [r[0] for r in cell("s", "7").collect()] == ["a", "7"]


def test_jdbc_options():
    from sparktab.sources.catalog import jdbc_options
    o = jdbc_options({"type": "postgresql", "host": "h", "database": "b", "query": "SELECT * FROM t;", "user": "u",
                      "partition_column": "id", "lower_bound": 0, "upper_bound": 10})
    assert o["url"] == "jdbc:postgresql://h:5432/b" and o["dbtable"] == "(SELECT * FROM t) src" and "query" not in o
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "0", "10", "64")
    with pytest.raises(ValueError):
        jdbc_options({"type": "oracle", "query": "x"})


def test_nearest_in_blocks_equals_one_block(spark):
    from sparktab.operators.retrieval import nearest
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q, s = e.where("vec_id % 5 = 0").selectExpr("vec_id AS qid", "embedding"), e.selectExpr("vec_id AS sid", "embedding")
    one, many = (sorted(map(tuple, nearest(q, s, 3, chunk=b).collect())) for b in (10000, 7))
    assert one == many and len(one) == 3 * q.count()
    assert nearest(q.limit(0), s, 3).count() == 0


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "value_roll7_mean" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_results_do_not_depend_on_session_time_zone(spark):
    """Timestamp arithmetic, windows and replay slicing use wall-clock (NTZ)
    semantics: the same rows under UTC and under a half-hour-offset zone."""
    from sparktab.plans.registry import load_all
    from tools.check import rows_of
    reg = load_all()
    names = ["tel_18_19_20_run_metrics", "tel_28_step_durations", "tel_42_stage_board", "str_03_windowed_counts"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        out = {}
        for tz in ("UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            out[tz] = {n: rows_of(reg[n].build(spark, SF_SMALL).toPandas()) for n in names}
        assert out["UTC"] == out["Asia/Kolkata"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_profile_approx_close_to_exact(spark):
    from sparktab.operators.profile import profile
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    ex = {r["column_name"]: r for r in profile(o).collect()}
    ap = {r["column_name"]: r for r in profile(o, approx=True).collect()}
    for c in ex:
        assert ex[c]["n_rows"] == ap[c]["n_rows"] and ex[c]["missing"] == ap[c]["missing"]
        assert abs(ex[c]["n_unique"] - ap[c]["n_unique"]) <= max(2, 0.05 * ex[c]["n_unique"])


def test_scale_conf_sizes_partitions():
    from sparktab.session import scale_conf
    c = scale_conf(100 * 1024 ** 4, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(10 * 1024 ** 2, 8)["spark.sql.shuffle.partitions"]) == 16


def test_profile_estimates_the_named_columns(spark):
    from sparktab.operators.profile import profile
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    ex = {r["column_name"]: r for r in profile(o).collect()}
    au = {r["column_name"]: r for r in profile(o, approx=["o_orderkey", "o_custkey", "o_totalprice"]).collect()}
    assert set(ex) == set(au)
    for c in ex:
        assert ex[c]["position"] == au[c]["position"] and ex[c]["missing"] == au[c]["missing"]
        if c not in ("o_orderkey", "o_custkey", "o_totalprice"):  # the others stay exact
            assert ex[c]["n_unique"] == au[c]["n_unique"]
