"""Exact quantiles, calendar lags and the metric index against plain versions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktab.operators.features import calendar_lags
from sparktab.operators.quantiles import exact_quantiles
from sparktab.operators.retrieval import nearest


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"hot": np.where(rng.random(5000) < 0.6, 7.0, rng.normal(size=5000)), "few": rng.integers(0, 4, 5000).astype(float),
                      "gaps": np.where(rng.random(5000) < 0.3, np.nan, rng.normal(size=5000)), "one": [5.0] * 5000})
    df = spark.createDataFrame(d).selectExpr("hot", "few", "if(isnan(gaps), null, gaps) gaps", "one", "cast(null as double) none", "cast(few as decimal(10,2)) money").repartition(6)
    qs = (0.0, 0.05, 1 / 3, 0.5, 0.75, 0.999, 1.0)
    got = exact_quantiles(df, {f"{c}_{i}": (c, q) for c in ("hot", "few", "gaps", "one", "none", "money") for i, q in enumerate(qs)}, parts=5).first()
    for c in ("hot", "few", "gaps", "one"):
        for i, q in enumerate(qs):
            assert got[f"{c}_{i}"] == pytest.approx(np.nanquantile(d[c], q), abs=1e-12)
    assert all(got[f"none_{i}"] is None and got[f"money_{i}"] == got[f"few_{i}"] for i in range(len(qs)))
    assert exact_quantiles(df.limit(0), {"a": ("hot", 0.5)}).first().a is None
    # as the engine's own percentile has it
    row = df.selectExpr("percentile(hot, 0.37) a", "percentile(gaps, 0.37) b").first()
    mine = exact_quantiles(df, {"a": ("hot", 0.37), "b": ("gaps", 0.37)}).first()
    assert mine.a == pytest.approx(row.a, abs=1e-12) and mine.b == pytest.approx(row.b, abs=1e-12)


def test_calendar_lags(spark):
    day = lambda n: dt.date(2024, 2, 25) + dt.timedelta(n)
    rows = [("a", day(n), float(n)) for n in (0, 1, 4, 8, 9)] + [(None, day(3), 30.0), (None, day(4), None), ("b", None, 1.0)]
    out = calendar_lags(spark.createDataFrame(rows, "s string, d date, v double"), "v", "d", ["s"], lags=(1, 7)).collect()
    got = {(r.s, r.d): (r.v, r.has_row, r.v_day_lag1, r.v_day_lag7) for r in out}
    assert set(got) == {("a", day(n)) for n in range(10)} | {(None, day(3)), (None, day(4))}
    assert got["a", day(1)] == (1.0, True, 0.0, None) and got["a", day(2)] == (None, False, 1.0, None)
    assert got["a", day(8)] == (8.0, True, None, 1.0) and got[None, day(4)] == (None, True, 30.0, None)


def brute(q, s, k):
    out = set()
    for i, a in q:
        d = sorted((sum((x - y) * (x - y) for x, y in zip(a, b)), j) for j, b in s)[:k]
        out |= {(i, j, r) for r, (_, j) in enumerate(d, 1)}
    return out


def test_metric_index(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(scale=30, size=(12, 6))
    s = [(i, (centres[i % 12 if i % 3 else 0] + rng.normal(size=6)).tolist()) for i in range(900)]
    s += [(900 + i, s[0][1]) for i in range(40)]  # ties
    q = [(i, v) for i, v in s if i % 10 == 0] + [(5000, [500.0] * 6), (5001, centres.mean(0).tolist())]
    schema = "{} bigint, embedding array<double>"
    qd, sd = spark.createDataFrame(q, schema.format("qid")), spark.createDataFrame(s + [(9999, None)], schema.format("sid"))
    for pivots, chunk in ((10, 4000), (64, 50), (1, 100)):
        got = nearest(qd, sd, 5, pivots=pivots, chunk=chunk).collect()
        assert {(r.qid, r.sid, r.rank) for r in got} == brute(q, s, 5) and len(got) == 5 * len(q)
    few = nearest(qd.limit(3), sd.where("sid < 3"), 5).collect()
    assert len(few) == 9
    assert nearest(qd, sd.limit(0)).count() == 0 and nearest(qd.limit(0), sd).count() == 0


def test_metric_index_prunes(spark, monkeypatch):
    """Far clusters: a query meets the stored vectors of its own cluster only."""
    from sparktab.operators import retrieval
    met = []
    whole = retrieval._compare

    def counted(asked, *rest):
        met.append(max(r.near for r in asked.collect()))
        return whole(asked, *rest)

    monkeypatch.setattr(retrieval, "_compare", counted)
    rng = np.random.default_rng(2)
    s = [(i, (np.eye(8)[i % 8] * 1000 + rng.normal(size=8)).tolist()) for i in range(400)]
    q = [(i, v) for i, v in s if i % 50 < 8]
    got = retrieval.nearest(spark.createDataFrame(q, "qid bigint, embedding array<double>"), spark.createDataFrame(s, "sid bigint, embedding array<double>"), 5, pivots=64).collect()
    assert {(r.qid, r.sid, r.rank) for r in got} == brute(q, s, 5)
    assert len(met) == 2 and max(met) < 100  # all cells compared, in either round, have their pivot in the query's cluster


def test_file_heads_cut_and_decode(spark, tmp_path):
    """Long first line, split character, latin1 bytes, empty file, line ends."""
    from sparktab.sources import sniff as SN
    files = {"long.txt": b"x" * 20000 + b"\nnext\n", "split.txt": b"a" * 8191 + "é".encode() + b"z\n", "latin.txt": "año;1\r\nniño;2\n".encode("latin1"),
             "empty.txt": b"", "many.txt": b"".join(b"%d\n" % i for i in range(100)), "exact.txt": b"b" * 8191 + b"\nafter\n"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {}
    for r in SN.file_heads(spark, str(tmp_path)).orderBy("file", "line_no").collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.encoding, r.value))
    assert got == {"long.txt": [("utf-8", "x" * 8192)], "split.txt": [("utf-8", "a" * 8191)], "latin.txt": [("latin1", "año;1"), ("latin1", "niño;2")],
                   "many.txt": [("utf-8", str(i)) for i in range(20)], "exact.txt": [("utf-8", "b" * 8191)]}


def test_file_heads_other_stores_by_readers(spark, tmp_path, monkeypatch):
    """Stores that tasks can't open are read by Spark: same whole lines."""
    from sparktab.sources import sniff as SN
    (tmp_path / "latin.txt").write_bytes("año;1\r\nniño;2\n".encode("latin1"))
    (tmp_path / "plain.txt").write_bytes(b"1\n2\n")
    direct = SN.file_heads(spark, str(tmp_path))
    want = sorted((r.file.rsplit("/", 1)[-1], r.encoding, r.line_no, r.value) for r in direct.collect())
    monkeypatch.setattr(SN, "RANGE_READ_SCHEMES", ())
    got = sorted((r.file.rsplit("/", 1)[-1], r.encoding, r.line_no, r.value) for r in SN.file_heads(spark, str(tmp_path)).collect())
    assert got == want and len(got) == 4


def test_read_and_profile_error_rows_and_faults(spark, tmp_path, monkeypatch):
    """Missing, empty and one-column sets are rows; a fault of ours is raised."""
    from sparktab.operators import profile as P
    for name, raw in {"good": b"a;b\n1;2\n3;\n", "blank": b"", "single": b"a\n1\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_bytes(raw)
    folders = [str(tmp_path / n) for n in ("good", "blank", "single", "none")]
    rows = P.read_and_profile(spark, folders).collect()
    assert {r.dataset: r.error_message for r in rows if r.read_status == "error"} == {"blank": "EMPTY", "single": "ONE_COLUMN", "none": "PATH_NOT_FOUND"}
    good = {r.column_name: (r.separator, r.has_header, r.n_rows, r.missing, r.n_unique) for r in rows if r.dataset == "good"}
    assert good == {"a": (";", True, 2, 0, 2), "b": (";", True, 2, 1, 1)}

    def broken(*_):
        raise RuntimeError("fault")
    monkeypatch.setattr(P.SN, "detect_options", broken)
    with pytest.raises(RuntimeError):
        P.read_and_profile(spark, folders)


def test_date_formats_odd_values(spark):
    """Null column, empty table, impossible dates, very long texts."""
    from sparktab.operators import profile as P
    df = spark.createDataFrame([(1, "3/4/2024 7:05", "9" * 50000, None, "15 nov. 2023"), (2, "31/02/2024", "", None, "2 mar. 2024"), (3, None, "x", None, "no")],
                               "id int, a string, long string, none string, loc string")
    got = {r.column_name: (r.ratio, r.is_date, r.format, r.sample_values) for r in P.date_formats(df, sample_by=["id"]).collect()}
    assert got["a"] == (0.333, False, "d/M/yyyy H:mm", ["3/4/2024 7:05", "31/02/2024"])
    assert got["none"] == (0.0, False, None, []) and got["long"][:3] == (0.0, False, None)
    assert got["loc"] == (0.667, True, "localised", ["15 nov. 2023", "2 mar. 2024", "no"])
    assert {r.ratio for r in P.date_formats(df.where("id < 0")).collect()} == {0.0}


def test_dataset_profile_names(spark):
    from sparktab.operators import profile as P
    df = spark.createDataFrame([(i, None if i == 2 else i * 1.5) for i in range(7)], "` id` int, `v  ` double")
    got = {r.column_name: (r.n_rows, r.n_columns, r.missing, r.sample_values) for r in P.dataset_profile(df, ["id"]).collect()}
    assert got == {"id": (7, 2, 0, ["0", "1", "2", "3", "4"]), "v": (7, 2, 1, ["0.0", "1.5", None, "4.5", "6.0"])}
    with pytest.raises(ValueError):
        P.dataset_profile(df.toDF("a", " a"))


def test_flagged_categoricals_and_problem_types(spark):
    """Null and empty tables, a column of nulls, a target with blanks."""
    from sparktab.operators import profile as P
    from sparktab.operators import steps as S
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3).cast("string").alias("few"), F.col("id").cast("string").alias("many"), F.lit(None).cast("string").alias("none"))
    assert S.flagged_categoricals(df) == ["few"] and S.flagged_categoricals(df.where("id < 0")) == [] and S.flagged_categoricals(df.select("id")) == []
    jobs = spark.createDataFrame([(t,) for t in ("id", " few ", "", " ", None, "gone")], "target_column string")
    got = [r.problem_type for r in P.problem_types(jobs, df).collect()]
    assert got == ["regression", "classification", "unsupervised", "unsupervised", "unsupervised", None]


def test_cascade_counts_odd_rows(spark):
    """Null job ids stay, an empty child counts 0, a missing child is refused."""
    from sparktab.operators import clean as C
    jobs = spark.range(5).select("id")
    logs = spark.createDataFrame([(0,), (0,), (1,), (None,)], "job_id bigint")
    tables = {"logs": logs, "models": logs.limit(0), "predictions": logs.where("job_id = 1")}
    got = {r.table_name: (r.remaining, r.deleted) for r in C.cascade_counts(jobs, tables, jobs.where("id = 0"), C.JOB_CASCADE).collect()}
    assert got == {"jobs": (4, 1), "predictions": (1, 0), "models": (0, 0), "logs": (2, 2)}
    with pytest.raises(ValueError):
        C.cascade_counts(jobs, tables, jobs, C.VERSION_CASCADE)


def test_report_blocks_odd_jobs(spark):
    """A job without agents' outputs, one unknown to the job table, and one
    with many prediction outputs in order."""
    from sparktab.operators import telemetry as T
    rows = [(1, i, "PredictionAgent", f"LOG_START: step {i} LOG_END:", 1000 + i) for i in range(700)]
    rows += [(2, 0, "ModelBuilderAgent", "hello", 5), (2, 1, "DataProcessorAgent", "ERROR_START: bad :ERROR_END", 9)]
    m = spark.createDataFrame(rows, "job_id bigint, seq bigint, agent_name string, content string, ts_s bigint")
    stats = spark.createDataFrame([], "job_id bigint, agent_name string, tokens_consumed bigint, calls_count bigint, total_execution_time double")
    jobs = spark.createDataFrame([(1, "y")], "id bigint, target_column string")
    models = spark.createDataFrame([(1,), (1,)], "job_id bigint")
    got = {r.job_id: r for r in T.report_blocks(m, T.agent_contributions(m, stats), jobs, models).collect()}
    assert got[1].prediction_details == " | ".join(f"step {i}" for i in range(700)) and got[1].prediction_tasks == 700 and got[1].prediction_success
    assert got[1].learning_type == "supervised" and len(got[1].achievements) == 2 and got[1].challenges == [] and got[1].training_attempts is None
    assert got[2].learning_type == "unsupervised" and got[2].final_model_details == "None" and got[2].achievements == [] and got[2].training_approach == "Isolation Forest"
    assert got[2].challenges == ["Resolved 1 errors during execution"] and got[2].data_findings is None
    assert {r.seq: r.execution_time for r in T.elapsed(m.where("job_id = 2")).collect()} == {0: 0.0, 1: 4.0}


def test_one_hot_text_spells_the_encoder_vector(spark):
    from sparktab.operators import steps as STP
    rows = [("a",), ("a",), ("b",), (None,), ("c",), ("b",), ("a",)]
    enc, (index, _) = STP.encode_categoricals(spark.createDataFrame(rows, "v string"), ["v"])
    k = len(index.labelsArray[0])
    got = enc.select("v", STP.one_hot_text(STP.hot_place(F.col("v_ohe")), F.lit(k)).alias("t")).distinct().collect()
    assert {r["v"]: r["t"] for r in got} == {"a": "100", "b": "010", "c": "001", None: "000"}


def test_flagged_one_hot_spells_vectors_out_after_the_count(spark, tmp_path):
    """Many events of many users: a vector an event would be 20,000 texts of 800 digits."""
    from sparktab.plans.registry import load_all
    n, users = 20_000, 800
    spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % users).alias("user_id"), F.lit("click").alias("event_type"),
                          F.timestamp_seconds(F.col("id") * 60 + 1704067200).cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value")) \
        .write.parquet(f"{tmp_path}/events.parquet")
    d = load_all()["fea_15_flagged_one_hot"].build(spark, str(tmp_path))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat(0" in plan.split("Aggregate")[0]  # above the count, not below it
    got = d.where("column_name = 'user_name'").toPandas()
    assert len(got) == users and (got["n"] == n // users).all()
    assert all(r.one_hot == "0" * int(r.value_index) + "1" + "0" * int(users - 1 - r.value_index) for r in got.itertuples())


def test_histogram_moves_no_row_by_its_group(spark):
    """Nearly all rows are of one group: only counts and ranges may be shuffled, whatever the tables' sizes."""
    from sparktab.operators.charts import histogram
    d = spark.range(5000).select((F.col("id") % 100 == 0).alias("g"), F.col("id").cast("double").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        h = histogram(d, "v", ["g"], 10)
        assert "SortMergeJoin" not in h._jdf.queryExecution().sparkPlan().toString()
        got = {(r["g"], r["bin"]): r["n"] for r in h.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {**{(True, b): 5 for b in range(10)}, **{(False, b): 495 for b in range(10)}}


def test_landing_writes_the_sets_a_query_reads(spark, tmp_path):
    import os
    from sparktab.plans import landing as L
    sf = str(tmp_path / "sf")
    os.symlink("/root/testdata/sf0.001", sf)  # a data directory that no other test has landed
    base = L.land(spark, sf, ["sales_daily"]).removeprefix("file:")
    assert os.listdir(base) == ["sales_daily"]
    first = sorted(os.listdir(f"{base}/sales_daily"))
    assert L.land(spark, sf).removeprefix("file:") == base
    assert sorted(os.listdir(base)) == sorted(L.DATASETS) and sorted(os.listdir(f"{base}/sales_daily")) == first


def test_forest_walk_takes_the_first_steps_by_table():
    """The nodes met are those of a plain walk: ties with a cut, missing values, early leaves, steps past the table."""
    import numpy as np

    from sparktab.operators import ml as ML
    rng = np.random.default_rng(5)
    x = np.stack([rng.random(700) * 1e5, rng.integers(0, 9, 700) / 100, rng.integers(-3, 4, 700)], 1)
    x[rng.random(x.shape) < 0.05] = np.nan
    forest = ML._Forest(6, 8)
    for t in range(1, 6):  # the first tree is a lone leaf
        for i in range(255):
            if rng.random() < 0.9 and (i == 0 or forest.feat[t, (i - 1) // 2] >= 0):
                f = forest.feat[t, i] = rng.integers(3)
                forest.thresh[t, i] = rng.choice(x[~np.isnan(x[:, f]), f])
    for steps in range(9):
        got = list(forest.walk(steps).nodes(list(x.T.copy())))
        for t in range(6):
            for r, node in zip(x, got[t]):
                i = 0
                for _ in range(steps):
                    if forest.feat[t, i] >= 0:
                        i = 2 * i + (1 if r[forest.feat[t, i]] < forest.thresh[t, i] else 2)
                assert i == node


def test_forest_counts_each_leaf_once(spark):
    """Sizes add up from the leaves, and each row of the key's sample stands in every tree that takes it."""
    from sparktab.operators import ml as ML
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 11 > 0, F.col("id") * 0.5).alias("b"), F.lit(1.0).alias("c"))
    model = ML.fit_isolation_forest(df, ["a", "b", "c"], ["id"], n_trees=70, max_depth=7)
    for _, g in model.nodes.groupby("tree"):
        size, left, right = g["size"].tolist(), g["left"].tolist(), g["right"].tolist()
        assert 2200 < size[0] < 2600 and set(g["feat"]) <= {-1, 0, 1}
        for n, a, b in zip(size, left, right):
            assert a < 0 or n == size[a] + size[b]
