"""Adapters: the reference's input shapes built from the driver's tables.

Every adapter exists twice, as a Spark function and as a DuckDB SQL text
(``SQL[name]``), so that each registered query can be checked against an
oracle that sees the same derived rows.  All residue rules are integer
arithmetic on keys, so both engines produce identical rows.

Money is summed as integer cents (``round(x*100)`` cast to bigint), which
makes sums exact and independent of the summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.sources.io import read_table
from sparktab.functions import dates as D

# ---------------------------------------------------------------------------
# fixed values (must equal the reference's)
# agent order of the process flow
AGENTS = ["DataProcessorAgent", "ModelBuilderAgent", "CodeExecutorAgent",
          "AnalystAgent", "PredictionAgent", "VisualizationAgent"]
# ---------------------------------------------------------------------------

# status of a job by (o_orderstatus, o_orderpriority); a chosen mapping
_STATUS_SQL = """CASE WHEN o_orderstatus = 'F' THEN 'completed'
     WHEN o_orderstatus = 'P' THEN 'failed'
     WHEN o_orderpriority = '1-URGENT' THEN 'processing'
     WHEN o_orderpriority = '2-HIGH' THEN 'analyzing_data'
     WHEN o_orderpriority = '3-MEDIUM' THEN 'training_model'
     WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'generating_predictions'
     ELSE 'awaiting_user_input' END"""

EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC


def tables(spark: SparkSession, sf_dir: str):
    """Small accessor: ``t = tables(spark, d); t.orders``."""
    class _T:
        def __getattr__(self, name):
            return read_table(spark, sf_dir, name)
    return _T()


# ---------------------------------------------------------------- daily series
def daily(orders: DataFrame) -> DataFrame:
    """(d DATE, value DOUBLE): one row per order day, revenue summed in cents."""
    return (orders
            .groupBy(F.to_date("o_orderdate").alias("d"))
            .agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100.0).alias("value")))


def daily_series(orders: DataFrame) -> DataFrame:
    """(series STRING, d DATE, value DOUBLE): one series per order priority."""
    return (orders
            .groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d"))
            .agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100.0).alias("value")))


def localised(orders: DataFrame) -> DataFrame:
    """(fecha STRING, monto_total STRING): the daily series as raw localised text
    (`15 nov. 2023`, September `sept.`; decimal comma, whole amounts without decimals)."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    g = orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(cents.alias("c"))
    amount = F.when(F.col("c") % 100 == 0, (F.col("c") / 100).cast("bigint").cast("string")).otherwise(
        F.concat((F.col("c") / 100).cast("bigint").cast("string"), F.lit(","),
                 F.lpad((F.col("c") % 100).cast("string"), 2, "0")))
    return g.select(D.format_localised(F.col("d")).alias("fecha"), amount.alias("monto_total"), "d")


# --------------------------------------------------------------------- invoices
def invoices(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Invoice table in the shape of the anomaly data set."""
    li = (lineitem.groupBy("l_orderkey")
          .agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")).alias("paid_c"),
               F.sum(F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("bigint")).alias("disc_c"),
               F.min("l_suppkey").alias("supp")))
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = customer.select("c_custkey", "c_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    k = F.col("o_orderkey")
    name = F.when(F.pmod(k, F.lit(17)) == 0, F.lit("/")).otherwise(
        F.concat(F.lit("FACT/"), F.year("o_orderdate").cast("string"), F.lit("/"), F.lpad(k.cast("string"), 5, "0")))
    paid = (F.when(F.pmod(k, F.lit(23)) == 0, F.lit(0.0))
            .when(F.pmod(k, F.lit(29)) == 0, F.col("o_totalprice") * 2)
            .otherwise(F.col("paid_c") / 100.0))
    return j.select(
        k.alias("invoice_key"),
        name.alias("factura_nombre"),
        F.col("o_totalprice").alias("factura_monto_total"),
        (F.col("disc_c") / 100.0).alias("factura_total_descuentos"),
        paid.alias("factura_total_pagos"),
        F.when(F.pmod(k, F.lit(31)) == 0, F.lit(None).cast("bigint")).otherwise(F.col("supp")).alias("vendedor_id"),
        F.when(F.pmod(F.col("o_custkey"), F.lit(13)) == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("cliente_nombre"),
    )


# ------------------------------------------------------------------------- jobs
def jobs(orders: DataFrame, with_version: bool = False) -> DataFrame:
    """Job table: one job per order; a family per customer, lowest key = parent.

    ``version_number`` (position in the family) needs the skew-safe ordered
    numbering, which materialises a checkpoint; it is computed only when
    asked for, so queries that do not use it pay nothing for it."""
    fam = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("parent_key"))
    o = orders.join(fam, "o_custkey")
    if with_version:
        from sparktab.operators.sequence import seq_number
        o = seq_number(o, ["o_custkey"], ["o_orderkey"], "version_number")
    else:
        o = o.withColumn("version_number", F.lit(None).cast("bigint"))
    k = F.col("o_orderkey")
    status = F.expr(_STATUS_SQL)
    return o.select(
        k.alias("id"),
        F.concat(F.lit("job-"), k.cast("string")).alias("name"),
        F.concat(F.lit("forecast revenue for customer "), F.col("o_custkey").cast("string"),
                 F.lit(" priority "), F.col("o_orderpriority"),
                 F.when(F.pmod(k, F.lit(3)) == 0, F.repeat(F.lit(" with lags and rolling features"), 3))
                 .otherwise(F.lit(""))).alias("prompt"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.lit(100)).otherwise(F.pmod(k, F.lit(90)).cast("int")).alias("progress"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit("")).otherwise(F.lit("monto_total")).alias("target_column"),
        F.when(k == F.col("parent_key"), F.lit(None).cast("bigint")).otherwise(F.col("parent_key")).alias("parent_job_id"),
        F.col("version_number"),
        (k == F.col("parent_key")).alias("is_parent"),
        F.col("o_custkey").alias("family"),
    )


# models: name by line number (fixed family prefixes of the AutoML leaderboard)
MODEL_PREFIX = ["GBM_1_AutoML_1", "DRF_1_AutoML_1", "GLM_1_AutoML_1", "XGBoost_1_AutoML_1",
                "StackedEnsemble_BestOfFamily_1_AutoML_1", "DeepLearning_1_AutoML_1",
                "StackedEnsemble_AllModels_1_AutoML_1"]


def models(lineitem: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(x) for x in MODEL_PREFIX])
    li = lineitem
    return li.select(
        (li.l_orderkey * 10 + li.l_linenumber).alias("id"),
        li.l_orderkey.alias("job_id"),
        F.element_at(names, li.l_linenumber).alias("name"),
        F.concat(F.lit("/models/job_"), li.l_orderkey.cast("string"), F.lit("/"),
                 F.element_at(names, li.l_linenumber)).alias("model_path"),
        F.concat(F.lit('{"rmse": '), F.round(li.l_extendedprice / 100, 2).cast("string"),
                 F.lit(', "mae": '), F.round(li.l_quantity, 2).cast("string"),
                 F.lit(', "r2": '), F.round(li.l_discount, 2).cast("string"),
                 F.lit(', "training_time": '), F.round(li.l_tax * 100, 2).cast("string"),
                 F.lit("}")).alias("metrics"),
    )


# ------------------------------------------------------------ agent messages
def _marker_expr(r, conv, turn):
    """Marker text appended to a message, chosen by a residue ``r`` of (conv, turn)."""
    return (F.when(r == 0, F.concat(F.lit("\nERROR_START: failure in step "), turn.cast("string"), F.lit(" :ERROR_END")))
            .when(r == 1, F.concat(F.lit("\nLOG_START: rows processed "), conv.cast("string"), F.lit(" LOG_END:")))
            .when(r == 2, F.concat(F.lit("\nMODEL_PATH_START: /models/job_"), conv.cast("string"), F.lit("/GBM_"),
                                   turn.cast("string"), F.lit(" :MODEL_PATH_END")))
            .when(r == 3, F.concat(F.lit('\nMETRICS_START: {"rmse": '), F.pmod(conv, F.lit(97)).cast("string"),
                                   F.lit(', "mae": '), turn.cast("string"), F.lit(', "r2": 0.5} :METRICS_END')))
            .when(r == 4, F.lit("\nWARNING: data drift detected"))
            .when(r == 5, F.lit("\nLOG_START: warning suppressed LOG_END: WARNING"))
            .when(r == 6, F.lit("\nPlease provide the target column"))
            .when(r == 7, F.concat(F.lit("\n```sql\nSELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = "),
                                   conv.cast("string"), F.lit("\n```\nrows: "), turn.cast("string")))
            .when(r == 8, F.concat(F.lit('\nMETRICS_START: {"rmse": 1234.5678, "mae": 987.6543, "mse": 1524157.8, '
                                         '"rmsle": 0.1234, "r2": 0.7123, "mean_residual_deviance": 1524157.8, "fold": '),
                                   turn.cast("string"), F.lit("} :METRICS_END")))
            .when(r == 9, F.lit("\nLOG_START: no end marker"))
            .when(r == 10, F.concat(F.lit("\nERROR_START: ModuleNotFoundError: No module named 'h2o' :ERROR_END\nTraceback")))
            .when(r == 11, F.lit("\nShould I proceed with the AgentEvent step?"))
            .otherwise(F.lit("")))


def agent_messages(conversations: DataFrame) -> DataFrame:
    """(job_id, seq, agent_name, content, message_type, ts_s, ts)."""
    c = conversations
    conv, turn = F.col("conv_id"), F.col("turn")
    r = F.pmod(conv * 7 + turn, F.lit(13))
    agents = F.array(*[F.lit(a) for a in AGENTS])
    agent = (F.when(F.col("role") == "user", F.lit("UserProxy"))
             .when(F.col("role") == "system", F.lit("System"))
             .otherwise(F.element_at(agents, (F.pmod(conv + turn, F.lit(6)) + 1).cast("int"))))
    ts_s = F.lit(EPOCH_2024) + conv * 3600 + turn * 37 + F.pmod(conv, F.lit(11)) * turn * 5
    return c.select(
        conv.alias("job_id"), turn.alias("seq"), agent.alias("agent_name"),
        F.concat(F.col("text"), _marker_expr(r, conv, turn)).alias("content"),
        F.lit("text").alias("message_type"),
        ts_s.cast("bigint").alias("ts_s"),
        (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(secs=ts_s.cast("decimal(18,6)"))).alias("ts"),  # wall time, no zone
    )


def agent_events(events: DataFrame) -> DataFrame:
    """(job_id, event_id, agent_name, ts, seconds, level)."""
    e = events
    return e.select(
        e.user_id.alias("job_id"), e.event_id, e.event_type.alias("agent_name"), e.ts,
        e.value.alias("seconds"),
        F.when(e.event_type == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"),
        F.concat(F.lit("Event "), e.event_type, F.lit(" value "), e.value.cast("string")).alias("message"),
    )


def agent_statistics(conversations: DataFrame) -> DataFrame:
    """Accumulated (job, agent) statistics: TEL-05 token estimate on each message."""
    m = agent_messages(conversations)
    tok = F.floor(F.length("content") / 4)
    return (m.groupBy("job_id", "agent_name")
            .agg(F.sum(tok).cast("bigint").alias("tokens_consumed"),
                 F.count(F.lit(1)).alias("calls_count"),
                 F.sum(F.floor(tok * 0.7)).cast("bigint").alias("input_tokens"),
                 F.sum(F.floor(tok * 0.3)).cast("bigint").alias("output_tokens"),
                 F.sum(F.col("ts_s") - F.lit(EPOCH_2024) - F.col("job_id") * 3600).cast("double").alias("total_execution_time"),
                 F.max("ts").alias("last_updated")))


# ------------------------------------------------------------- execution logs
SCRIPT_NAMES = ["train_model.py", "model_h2o_prediction.py", "predict.py", "visualization_script.py",
                "plot_results.py", "preprocess_data.py", "clean_data.py", "data_analysis.py", "report.py"]


def exec_logs(events: DataFrame) -> DataFrame:
    """One script run per event: (run_id, job_id, script_name, exit_code, output)."""
    e = events
    k = e.event_id
    r = F.pmod(k, F.lit(7))
    names = F.array(*[F.lit(x) for x in SCRIPT_NAMES])
    secs = F.format_string("%.2f", e.value)
    attempt = (F.pmod(k, F.lit(3)) + 1).cast("string")
    out = (F.when(r == 0, F.concat(F.lit("=== Execution successful (attempt "), attempt, F.lit("/3) in "), secs, F.lit("s ===\nok")))
           .when(r == 1, F.concat(F.lit("=== Execution successful (attempt "), attempt, F.lit("/3) in "), secs,
                                  F.lit("s ===\nTraceback (most recent call last):\nValueError")))
           .when(r == 2, F.concat(F.lit("Execution error (not missing module). Attempts: "), attempt, F.lit("\nKeyError: 'fecha'")))
           .when(r == 3, F.lit("Traceback (most recent call last):\nModuleNotFoundError: No module named 'h2o'"))
           .when(r == 4, F.concat(F.lit("=== Execution successful (attempt 1/3) in "), secs, F.lit('s ===\n{"error": "bad input"}')))
           .when(r == 5, F.lit("Failed after 3 attempts. No module named \"xgboost.sklearn\""))
           .otherwise(F.concat(F.lit("=== Execution successful (attempt "), attempt, F.lit("/3) in "), secs,
                               F.lit("s ===\nERROR_START: minor :ERROR_END"))))
    return e.select(
        k.alias("run_id"), e.user_id.alias("job_id"),
        F.element_at(names, (F.pmod(k, F.lit(9)) + 1).cast("int")).alias("script_name"),
        F.when(r.isin(0, 1, 4, 6), F.lit(0)).otherwise(F.lit(1)).alias("exit_code"),
        out.alias("output"), e.ts,
    )


# ------------------------------------------------------------------ SQL texts
def query_log(orders: DataFrame) -> DataFrame:
    """A log of SQL texts, one per order, from 12 templates chosen by key residue."""
    k = F.col("o_orderkey")
    ks = k.cast("string")
    r = F.pmod(k, F.lit(12))
    q = (F.when(r == 0, F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), ks))
         .when(r == 1, F.concat(F.lit("  select o_custkey, count(*) from orders where active = 1 group by o_custkey -- "), ks))
         .when(r == 2, F.concat(F.lit("WITH t AS (SELECT * FROM orders) SELECT * FROM t WHERE o_orderkey = "), ks))
         .when(r == 3, F.concat(F.lit("```sql\nSELECT o_orderkey FROM orders WHERE o_custkey = "), ks, F.lit("\n```")))
         .when(r == 4, F.concat(F.lit("EXPLAIN SELECT o_totalprice FROM orders WHERE o_orderkey = "), ks))
         .when(r == 5, F.concat(F.lit("SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem WHERE l_orderkey < "), ks))
         .when(r == 6, F.concat(F.lit("SELECT a FROM t UNION ALL SELECT b FROM u WHERE k = "), ks))
         .when(r == 7, F.concat(F.lit("SELECT * FROM orders WHERE o_custkey NOT IN (1, NULL, "), ks, F.lit(")")))
         .when(r == 8, F.concat(F.lit("SELECT c_name, credit_limit FROM customer WHERE c_custkey = "), ks))
         .when(r == 9, F.concat(F.lit("SELECT * FROM orders WHERE active=0 AND o_orderkey = "), ks, F.lit(" LIMIT 10")))
         .when(r == 10, F.concat(F.lit("DELETE FROM orders WHERE o_orderkey = "), ks))
         .otherwise(F.concat(F.lit("SELECT 'error' AS msg, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT\nNULL) AND k = "), ks)))
    return orders.select(k.alias("q_id"), q.alias("sql_text"))


# ------------------------------------------------------------ wide profile frame
def wide_customer(customer: DataFrame) -> DataFrame:
    """customer with nulls planted by key residue, a binary flag, an empty
    column and name-role columns (for the profile queries)."""
    k = F.col("c_custkey")
    return customer.select(
        k.alias("customer_id"),
        F.when(F.pmod(k, F.lit(19)) == 0, F.lit(None)).otherwise(F.col("c_name")).alias("c_name"),
        F.col("c_nationkey"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.pmod(k, F.lit(11)) == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        (F.pmod(k, F.lit(5)) == 0).cast("int").alias("is_vip"),
        F.lit("crm").alias("source_system"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@mail.test")).alias("contact_email"),
        F.lit(None).cast("string").alias("empty_note"),
    )


# ======================================================================== SQL
SQL = {
    "daily": """SELECT CAST(o_orderdate AS DATE) AS d,
       sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS value
FROM orders GROUP BY 1""",
    "daily_series": """SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d,
       sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS value
FROM orders GROUP BY 1, 2""",
    "localised": """SELECT CAST(day(d) AS VARCHAR) || ' ' ||
         ['ene.','feb.','mar.','abr.','may.','jun.','jul.','ago.','sept.','oct.','nov.','dic.'][month(d)]
         || ' ' || CAST(year(d) AS VARCHAR) AS fecha,
       CASE WHEN c % 100 = 0 THEN CAST(c // 100 AS VARCHAR)
            ELSE CAST(c // 100 AS VARCHAR) || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS monto_total,
       d
FROM (SELECT CAST(o_orderdate AS DATE) AS d, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c
      FROM orders GROUP BY 1)""",
    "invoices": """SELECT o.o_orderkey AS invoice_key,
       CASE WHEN o.o_orderkey % 17 = 0 THEN '/'
            ELSE 'FACT/' || CAST(year(o.o_orderdate) AS VARCHAR) || '/' || lpad(CAST(o.o_orderkey AS VARCHAR), 5, '0') END AS factura_nombre,
       o.o_totalprice AS factura_monto_total,
       li.disc_c / 100.0 AS factura_total_descuentos,
       CASE WHEN o.o_orderkey % 23 = 0 THEN 0.0 WHEN o.o_orderkey % 29 = 0 THEN o.o_totalprice * 2
            ELSE li.paid_c / 100.0 END AS factura_total_pagos,
       CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE li.supp END AS vendedor_id,
       CASE WHEN o.o_custkey % 13 = 0 THEN NULL ELSE c.c_name END AS cliente_nombre
FROM (SELECT l_orderkey,
             sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS paid_c,
             sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS disc_c,
             min(l_suppkey) AS supp
      FROM lineitem GROUP BY l_orderkey) li
JOIN orders o ON li.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
    "jobs": f"""SELECT o_orderkey AS id, 'job-' || CAST(o_orderkey AS VARCHAR) AS name,
       'forecast revenue for customer ' || CAST(o_custkey AS VARCHAR) || ' priority ' || o_orderpriority
         || CASE WHEN o_orderkey % 3 = 0 THEN repeat(' with lags and rolling features', 3) ELSE '' END AS prompt,
       {_STATUS_SQL} AS status,
       o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'F' THEN 100 ELSE CAST(o_orderkey % 90 AS INTEGER) END AS progress,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'monto_total' END AS target_column,
       CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN NULL
            ELSE min(o_orderkey) OVER (PARTITION BY o_custkey) END AS parent_job_id,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_number,
       o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS is_parent,
       o_custkey AS family
FROM orders""",
    "models": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job_id,
       ['GBM_1_AutoML_1','DRF_1_AutoML_1','GLM_1_AutoML_1','XGBoost_1_AutoML_1',
        'StackedEnsemble_BestOfFamily_1_AutoML_1','DeepLearning_1_AutoML_1',
        'StackedEnsemble_AllModels_1_AutoML_1'][l_linenumber] AS name,
       '/models/job_' || CAST(l_orderkey AS VARCHAR) || '/' ||
       ['GBM_1_AutoML_1','DRF_1_AutoML_1','GLM_1_AutoML_1','XGBoost_1_AutoML_1',
        'StackedEnsemble_BestOfFamily_1_AutoML_1','DeepLearning_1_AutoML_1',
        'StackedEnsemble_AllModels_1_AutoML_1'][l_linenumber] AS model_path,
       '{"rmse": ' || CAST(((CAST(round(l_extendedprice * 100) AS BIGINT) + 50) // 100) / 100.0 AS VARCHAR) || ', "mae": ' || CAST(round(l_quantity, 2) AS VARCHAR)
       || ', "r2": ' || CAST(round(l_discount, 2) AS VARCHAR) || ', "training_time": ' || CAST(round(l_tax * 100, 2) AS VARCHAR)
       || '}' AS metrics
FROM lineitem""",
    "agent_messages": """SELECT conv_id AS job_id, turn AS seq,
       CASE WHEN role = 'user' THEN 'UserProxy' WHEN role = 'system' THEN 'System'
            ELSE ['DataProcessorAgent','ModelBuilderAgent','CodeExecutorAgent','AnalystAgent','PredictionAgent',
                  'VisualizationAgent'][CAST((conv_id + turn) % 6 AS INTEGER) + 1] END AS agent_name,
       text || CASE (conv_id * 7 + turn) % 13
         WHEN 0 THEN chr(10) || 'ERROR_START: failure in step ' || CAST(turn AS VARCHAR) || ' :ERROR_END'
         WHEN 1 THEN chr(10) || 'LOG_START: rows processed ' || CAST(conv_id AS VARCHAR) || ' LOG_END:'
         WHEN 2 THEN chr(10) || 'MODEL_PATH_START: /models/job_' || CAST(conv_id AS VARCHAR) || '/GBM_' || CAST(turn AS VARCHAR) || ' :MODEL_PATH_END'
         WHEN 3 THEN chr(10) || 'METRICS_START: {"rmse": ' || CAST(conv_id % 97 AS VARCHAR) || ', "mae": ' || CAST(turn AS VARCHAR) || ', "r2": 0.5} :METRICS_END'
         WHEN 4 THEN chr(10) || 'WARNING: data drift detected'
         WHEN 5 THEN chr(10) || 'LOG_START: warning suppressed LOG_END: WARNING'
         WHEN 6 THEN chr(10) || 'Please provide the target column'
         WHEN 7 THEN chr(10) || '```sql' || chr(10) || 'SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ' || CAST(conv_id AS VARCHAR) || chr(10) || '```' || chr(10) || 'rows: ' || CAST(turn AS VARCHAR)
         WHEN 8 THEN chr(10) || 'METRICS_START: {"rmse": 1234.5678, "mae": 987.6543, "mse": 1524157.8, "rmsle": 0.1234, "r2": 0.7123, "mean_residual_deviance": 1524157.8, "fold": ' || CAST(turn AS VARCHAR) || '} :METRICS_END'
         WHEN 9 THEN chr(10) || 'LOG_START: no end marker'
         WHEN 10 THEN chr(10) || 'ERROR_START: ModuleNotFoundError: No module named ''h2o'' :ERROR_END' || chr(10) || 'Traceback'
         WHEN 11 THEN chr(10) || 'Should I proceed with the AgentEvent step?'
         ELSE '' END AS content,
       'text' AS message_type,
       CAST(1704067200 + conv_id * 3600 + turn * 37 + (conv_id % 11) * turn * 5 AS BIGINT) AS ts_s,
       make_timestamp(CAST(1704067200 + conv_id * 3600 + turn * 37 + (conv_id % 11) * turn * 5 AS BIGINT) * 1000000) AS ts
FROM conversations""",
    "agent_events": """SELECT user_id AS job_id, event_id, event_type AS agent_name, ts, value AS seconds,
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       'Event ' || event_type || ' value ' || CAST(value AS VARCHAR) AS message
FROM events""",
    "exec_logs": """SELECT event_id AS run_id, user_id AS job_id,
       ['train_model.py','model_h2o_prediction.py','predict.py','visualization_script.py','plot_results.py',
        'preprocess_data.py','clean_data.py','data_analysis.py','report.py'][CAST(event_id % 9 AS INTEGER) + 1] AS script_name,
       CASE WHEN event_id % 7 IN (0, 1, 4, 6) THEN 0 ELSE 1 END AS exit_code,
       CASE event_id % 7
         WHEN 0 THEN '=== Execution successful (attempt ' || CAST(event_id % 3 + 1 AS VARCHAR) || '/3) in ' || printf('%.2f', value) || 's ===' || chr(10) || 'ok'
         WHEN 1 THEN '=== Execution successful (attempt ' || CAST(event_id % 3 + 1 AS VARCHAR) || '/3) in ' || printf('%.2f', value) || 's ===' || chr(10) || 'Traceback (most recent call last):' || chr(10) || 'ValueError'
         WHEN 2 THEN 'Execution error (not missing module). Attempts: ' || CAST(event_id % 3 + 1 AS VARCHAR) || chr(10) || 'KeyError: ''fecha'''
         WHEN 3 THEN 'Traceback (most recent call last):' || chr(10) || 'ModuleNotFoundError: No module named ''h2o'''
         WHEN 4 THEN '=== Execution successful (attempt 1/3) in ' || printf('%.2f', value) || 's ===' || chr(10) || '{"error": "bad input"}'
         WHEN 5 THEN 'Failed after 3 attempts. No module named "xgboost.sklearn"'
         ELSE '=== Execution successful (attempt ' || CAST(event_id % 3 + 1 AS VARCHAR) || '/3) in ' || printf('%.2f', value) || 's ===' || chr(10) || 'ERROR_START: minor :ERROR_END' END AS output,
       ts
FROM events""",
    "query_log": """SELECT o_orderkey AS q_id, CASE o_orderkey % 12
  WHEN 0 THEN 'SELECT * FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR)
  WHEN 1 THEN '  select o_custkey, count(*) from orders where active = 1 group by o_custkey -- ' || CAST(o_orderkey AS VARCHAR)
  WHEN 2 THEN 'WITH t AS (SELECT * FROM orders) SELECT * FROM t WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR)
  WHEN 3 THEN '```sql' || chr(10) || 'SELECT o_orderkey FROM orders WHERE o_custkey = ' || CAST(o_orderkey AS VARCHAR) || chr(10) || '```'
  WHEN 4 THEN 'EXPLAIN SELECT o_totalprice FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR)
  WHEN 5 THEN 'SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem WHERE l_orderkey < ' || CAST(o_orderkey AS VARCHAR)
  WHEN 6 THEN 'SELECT a FROM t UNION ALL SELECT b FROM u WHERE k = ' || CAST(o_orderkey AS VARCHAR)
  WHEN 7 THEN 'SELECT * FROM orders WHERE o_custkey NOT IN (1, NULL, ' || CAST(o_orderkey AS VARCHAR) || ')'
  WHEN 8 THEN 'SELECT c_name, credit_limit FROM customer WHERE c_custkey = ' || CAST(o_orderkey AS VARCHAR)
  WHEN 9 THEN 'SELECT * FROM orders WHERE active=0 AND o_orderkey = ' || CAST(o_orderkey AS VARCHAR) || ' LIMIT 10'
  WHEN 10 THEN 'DELETE FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR)
  ELSE 'SELECT ''error'' AS msg, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT' || chr(10) || 'NULL) AND k = ' || CAST(o_orderkey AS VARCHAR) END AS sql_text
FROM orders""",
}
SQL["wide_customer"] = """SELECT c_custkey AS customer_id,
       CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_name END AS c_name, c_nationkey,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       CAST(c_custkey % 5 = 0 AS INTEGER) AS is_vip, 'crm' AS source_system,
       lower(replace(c_name, '#', '')) || '@mail.test' AS contact_email,
       CAST(NULL AS VARCHAR) AS empty_note
FROM customer"""
SQL["agent_statistics"] = f"""SELECT job_id, agent_name,
       CAST(sum(floor(length(content) / 4)) AS BIGINT) AS tokens_consumed,
       count(*) AS calls_count,
       CAST(sum(floor(floor(length(content) / 4) * 0.7)) AS BIGINT) AS input_tokens,
       CAST(sum(floor(floor(length(content) / 4) * 0.3)) AS BIGINT) AS output_tokens,
       CAST(sum(ts_s - 1704067200 - job_id * 3600) AS DOUBLE) AS total_execution_time,
       max(ts) AS last_updated
FROM agent_messages GROUP BY job_id, agent_name"""

# which adapters an adapter's SQL depends on (emitted first)
DEPENDS = {"agent_statistics": ["agent_messages"]}


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named adapters (dependencies first)."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n"
