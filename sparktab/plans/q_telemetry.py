"""Registered queries: run-tracking analytics over all jobs (TEL-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktab.operators import models as M
from sparktab.operators import telemetry as T
from sparktab.operators.profile import top_k
from sparktab.operators.sequence import one_row, ordered_text
from sparktab.plans import views as V
from sparktab.plans.registry import register


def _t(spark, sf):
    return V.tables(spark, sf)


def _msgs(spark, sf):
    return V.agent_messages(_t(spark, sf).conversations)


def _stats(spark, sf):
    return V.agent_statistics(_t(spark, sf).conversations)


def _jobs(spark, sf, with_version: bool = False):
    return V.jobs(_t(spark, sf).orders, with_version)


def _events(spark, sf):
    return V.agent_events(_t(spark, sf).events)


def _between_sql(col: str, start: str, end: str) -> str:
    pat = f"(?s){start}(.*?){end}"
    return (f"CASE WHEN regexp_matches({col}, '{pat}') THEN "
            f"regexp_replace(regexp_extract({col}, '{pat}', 1), '^\\s+|\\s+$', '', 'g') END")


# per-message marker outputs (mirrors telemetry.message_outputs)
_MO = f"""
, raw AS (SELECT *, {_between_sql('content', 'ERROR_START:', ':ERROR_END')} AS e,
                 {_between_sql('content', 'LOG_START:', 'LOG_END:')} AS lg,
                 {_between_sql('content', 'MODEL_PATH_START:', ':MODEL_PATH_END')} AS mp,
                 {_between_sql('content', 'METRICS_START:', ':METRICS_END')} AS mt FROM agent_messages)
, mo AS (SELECT *, CASE WHEN e <> '' THEN e END AS error_text,
                CASE WHEN lg <> '' AND NOT contains(content, 'WARNING') THEN lg END AS out_log,
                CASE WHEN mp <> '' THEN 'Model saved: ' || mp END AS out_model,
                CASE WHEN mt <> '' THEN 'Metrics generated: ' || substr(mt, 1, 100) || '...' END AS out_metrics,
                contains(upper(content), 'WARNING') AS is_warning FROM raw)
, mo2 AS (SELECT *, CAST(out_log IS NOT NULL AS INTEGER) + CAST(out_model IS NOT NULL AS INTEGER)
                 + CAST(out_metrics IS NOT NULL AS INTEGER) AS n_outputs FROM mo)
, outs AS (SELECT job_id, agent_name, seq, 1 AS k, out_log AS output FROM mo2 WHERE out_log IS NOT NULL
           UNION ALL SELECT job_id, agent_name, seq, 2, out_model FROM mo2 WHERE out_model IS NOT NULL
           UNION ALL SELECT job_id, agent_name, seq, 3, out_metrics FROM mo2 WHERE out_metrics IS NOT NULL)
, contrib AS (SELECT c.job_id, c.agent_name, messages, errors, key_outputs, warnings,
                     CAST(coalesce(s.tokens_consumed, 0) AS BIGINT) AS tokens, CAST(coalesce(s.calls_count, 0) AS BIGINT) AS calls,
                     coalesce(s.total_execution_time, 0.0) AS exec_time
              FROM (SELECT job_id, agent_name, count(*) AS messages, count(error_text) AS errors,
                           CAST(sum(n_outputs) AS BIGINT) AS key_outputs, count(*) FILTER (WHERE is_warning) AS warnings
                    FROM mo2 GROUP BY job_id, agent_name) c
              LEFT JOIN agent_statistics s ON c.job_id = s.job_id AND c.agent_name = s.agent_name)
"""
_MSG_SQL = V.with_views("agent_messages", "agent_statistics") + _MO


@register("tel_01_status_board", sql=V.with_views("jobs") + """
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs,
  count(*) FILTER (WHERE status IN ('processing', 'analyzing_data', 'training_model', 'generating_predictions')) AS running_jobs,
  count(*) FILTER (WHERE status = 'awaiting_user_input') AS waiting_jobs,
  count(*) FILTER (WHERE status = 'failed') AS failed_jobs FROM jobs""")
def tel_01(spark, sf):
    j = _jobs(spark, sf)
    s = F.col("status")
    return j.agg(F.count(F.lit(1)).alias("total_jobs"), F.count_if(s == "completed").alias("completed_jobs"),
                 F.count_if(s.isin(*T.RUNNING_STATUSES)).alias("running_jobs"),
                 F.count_if(s == T.WAITING_STATUS).alias("waiting_jobs"), F.count_if(s == "failed").alias("failed_jobs"))


@register("tel_02_recent_jobs", dates=["created_at"], sql=V.with_views("jobs") + """
SELECT id, name, status, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 5""")
def tel_02(spark, sf):
    """Latest-first list, the recent five (a top-k report)."""
    return _jobs(spark, sf).orderBy(F.desc("created_at"), F.desc("id")).limit(5).select("id", "name", "status", "created_at")


@register("tel_03_accumulating_upsert", dates=["last_updated"], sql=V.with_views("agent_messages") + """
, old AS (SELECT job_id, agent_name, CAST(sum(floor(length(content) / 4)) AS BIGINT) AS tokens_consumed, count(*) AS calls_count,
                 CAST(sum(floor(floor(length(content) / 4) * 0.7)) AS BIGINT) AS input_tokens,
                 CAST(sum(floor(floor(length(content) / 4) * 0.3)) AS BIGINT) AS output_tokens,
                 CAST(sum(ts_s - 1704067200 - job_id * 3600) AS DOUBLE) AS total_execution_time, max(ts) AS last_updated
          FROM agent_messages WHERE seq < 4 GROUP BY job_id, agent_name)
, delta AS (SELECT job_id, agent_name, CAST(floor(length(content) / 4) AS BIGINT) AS tokens_consumed, CAST(1 AS BIGINT) AS calls_count,
                   CAST(floor(floor(length(content) / 4) * 0.7) AS BIGINT) AS input_tokens,
                   CAST(floor(floor(length(content) / 4) * 0.3) AS BIGINT) AS output_tokens,
                   CAST(ts_s - 1704067200 - job_id * 3600 AS DOUBLE) AS total_execution_time, ts AS last_updated
            FROM agent_messages WHERE seq >= 4)
SELECT job_id, agent_name, CAST(sum(tokens_consumed) AS BIGINT) AS tokens_consumed, CAST(sum(calls_count) AS BIGINT) AS calls_count,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  sum(total_execution_time) AS total_execution_time, max(last_updated) AS last_updated
FROM (SELECT * FROM old UNION ALL SELECT * FROM delta) GROUP BY job_id, agent_name""")
def tel_03(spark, sf):
    """Incremental upsert: statistics of the first turns plus the later calls
    re-aggregated; equals the batch statistics over all turns."""
    m = _msgs(spark, sf)
    tok = F.floor(F.length("content") / 4)
    old = (m.where(F.col("seq") < 4).groupBy("job_id", "agent_name")
           .agg(F.sum(tok).cast("bigint").alias("tokens_consumed"), F.count(F.lit(1)).alias("calls_count"),
                F.sum(F.floor(tok * 0.7)).cast("bigint").alias("input_tokens"),
                F.sum(F.floor(tok * 0.3)).cast("bigint").alias("output_tokens"),
                F.sum(F.col("ts_s") - F.lit(V.EPOCH_2024) - F.col("job_id") * 3600).cast("double").alias("total_execution_time"),
                F.max("ts").alias("last_updated")))
    delta = m.where(F.col("seq") >= 4).select(
        "job_id", "agent_name", tok.cast("bigint").alias("tokens"), F.floor(tok * 0.7).cast("bigint").alias("input_tokens"),
        F.floor(tok * 0.3).cast("bigint").alias("output_tokens"),
        (F.col("ts_s") - F.lit(V.EPOCH_2024) - F.col("job_id") * 3600).cast("double").alias("execution_time"), "ts")
    return T.accumulate_stats(old, delta)


_ELAPSED_MSGS = V.with_views("agent_messages") + """
, m AS (SELECT a.*, floor(length(content) / 4) AS tok, CAST(ts_s - first_s AS DOUBLE) AS el
        FROM agent_messages a JOIN (SELECT job_id, min(ts_s) AS first_s FROM agent_messages GROUP BY job_id) USING (job_id))
"""


@register("tel_03_elapsed_upsert", dates=["last_updated"], sql=_ELAPSED_MSGS + """
SELECT job_id, agent_name, CAST(sum(tok) AS BIGINT) AS tokens_consumed, count(*) AS calls_count, CAST(sum(floor(tok * 0.7)) AS BIGINT) AS input_tokens,
  CAST(sum(floor(tok * 0.3)) AS BIGINT) AS output_tokens, sum(el) AS total_execution_time, max(ts) AS last_updated FROM m GROUP BY job_id, agent_name""")
def tel_03_elapsed(spark, sf):
    """Totals of the earlier calls upserted with the later ones; a call's time
    is what has passed since its job's first message."""
    c = T.token_estimate(T.elapsed(_msgs(spark, sf)), ("ts", "execution_time", "seq"))
    early = c.where(F.col("seq") < 4).groupBy("job_id", "agent_name").agg(
        F.sum("tokens").alias("tokens_consumed"), F.count(F.lit(1)).alias("calls_count"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("execution_time").alias("total_execution_time"), F.max("ts").alias("last_updated"))
    r = T.accumulate_stats(early, c.where(F.col("seq") >= 4))
    return r.select("job_id", "agent_name", *[F.col(x).cast("bigint").alias(x) for x in ("tokens_consumed", "calls_count", "input_tokens", "output_tokens")],
                    "total_execution_time", "last_updated")


@register("tel_04_job_summary", dates=["last_activity"], sql=V.with_views("jobs", "agent_statistics") + """
SELECT j.id AS job_id, count(DISTINCT s.agent_name) AS unique_agents, CAST(coalesce(sum(s.calls_count), 0) AS BIGINT) AS total_calls,
  CAST(coalesce(sum(s.tokens_consumed), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(s.input_tokens), 0) AS BIGINT) AS total_input_tokens,
  CAST(coalesce(sum(s.output_tokens), 0) AS BIGINT) AS total_output_tokens, coalesce(sum(s.total_execution_time), 0.0) AS total_execution_time,
  max(s.last_updated) AS last_activity
FROM jobs j LEFT JOIN agent_statistics s ON j.id = s.job_id GROUP BY j.id""")
def tel_04(spark, sf):
    s = _stats(spark, sf)
    g = s.groupBy("job_id").agg(F.count_distinct("agent_name").alias("unique_agents"),
                                F.sum("calls_count").alias("c"), F.sum("tokens_consumed").alias("tk"),
                                F.sum("input_tokens").alias("it"), F.sum("output_tokens").alias("ot"),
                                F.sum("total_execution_time").alias("et"), F.max("last_updated").alias("last_activity"))
    j = _jobs(spark, sf).select(F.col("id").alias("job_id"))
    r = j.join(g, "job_id", "left")
    return r.select("job_id", F.coalesce("unique_agents", F.lit(0)).alias("unique_agents"),
                    F.coalesce("c", F.lit(0)).cast("bigint").alias("total_calls"),
                    F.coalesce("tk", F.lit(0)).cast("bigint").alias("total_tokens"),
                    F.coalesce("it", F.lit(0)).cast("bigint").alias("total_input_tokens"),
                    F.coalesce("ot", F.lit(0)).cast("bigint").alias("total_output_tokens"),
                    F.coalesce("et", F.lit(0.0)).alias("total_execution_time"), "last_activity")


@register("tel_05_token_estimate", sql=V.with_views("agent_messages") + """
SELECT job_id, seq, agent_name, CAST(floor(length(content) / 4) AS BIGINT) AS tokens,
  CAST(floor(floor(length(content) / 4) * 0.7) AS BIGINT) AS input_tokens,
  CAST(floor(floor(length(content) / 4) * 0.3) AS BIGINT) AS output_tokens FROM agent_messages""")
def tel_05(spark, sf):
    return T.token_estimate(_msgs(spark, sf))


@register("tel_06_statistics_listing", sql=V.with_views("agent_statistics") + """
SELECT job_id, agent_name, calls_count, tokens_consumed,
  CASE WHEN calls_count > 0 THEN round(tokens_consumed / calls_count, 1) ELSE 0 END AS avg_tokens_per_call,
  row_number() OVER (PARTITION BY job_id ORDER BY calls_count DESC, tokens_consumed DESC, agent_name) AS rank
FROM agent_statistics""")
def tel_06(spark, sf):
    s = _stats(spark, sf)
    w = Window.partitionBy("job_id").orderBy(F.desc("calls_count"), F.desc("tokens_consumed"), "agent_name")
    return s.select("job_id", "agent_name", "calls_count", "tokens_consumed",
                    F.when(F.col("calls_count") > 0, F.round(F.col("tokens_consumed") / F.col("calls_count"), 1))
                    .otherwise(F.lit(0.0)).alias("avg_tokens_per_call"),
                    F.row_number().over(w).alias("rank"))


@register("tel_07_marker_extraction", sql=V.with_views("agent_messages") + f"""
SELECT job_id, seq, {_between_sql('content', 'ERROR_START:', ':ERROR_END')} AS error_text,
  {_between_sql('content', 'LOG_START:', 'LOG_END:')} AS log_text,
  {_between_sql('content', 'MODEL_PATH_START:', ':MODEL_PATH_END')} AS model_path,
  {_between_sql('content', 'METRICS_START:', ':METRICS_END')} AS metrics_text
FROM agent_messages""")
def tel_07(spark, sf):
    c = F.col("content")
    return _msgs(spark, sf).select(
        "job_id", "seq", T.between(c, "ERROR_START:", ":ERROR_END").alias("error_text"),
        T.between(c, "LOG_START:", "LOG_END:").alias("log_text"),
        T.between(c, "MODEL_PATH_START:", ":MODEL_PATH_END").alias("model_path"),
        T.between(c, "METRICS_START:", ":METRICS_END").alias("metrics_text"))


@register("tel_08_metrics_payload", sql=V.with_views("agent_messages") + f"""
SELECT job_id, seq, CAST(json_extract(m, '$.rmse') AS DOUBLE) AS rmse, CAST(json_extract(m, '$.mae') AS DOUBLE) AS mae,
  CAST(json_extract(m, '$.r2') AS DOUBLE) AS r2
FROM (SELECT job_id, seq, {_between_sql('content', 'METRICS_START:', ':METRICS_END')} AS m FROM agent_messages) WHERE m IS NOT NULL""")
def tel_08(spark, sf):
    m = _msgs(spark, sf).select("job_id", "seq", T.between(F.col("content"), "METRICS_START:", ":METRICS_END").alias("m"))
    p = F.from_json("m", "rmse double, mae double, r2 double")
    return m.where(F.col("m").isNotNull()).select("job_id", "seq", p["rmse"].alias("rmse"), p["mae"].alias("mae"),
                                                  p["r2"].alias("r2"))


@register("tel_09_agent_contributions", sql=_MSG_SQL + "SELECT * FROM contrib")
def tel_09(spark, sf):
    return T.agent_contributions(_msgs(spark, sf), _stats(spark, sf))


@register("tel_10_first_outputs", sql=_MSG_SQL + """
SELECT job_id, agent_name, seq, k, output, position FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, agent_name ORDER BY seq, k) AS position FROM outs) WHERE position <= 3""")
def tel_10(spark, sf):
    return T.first_outputs(_msgs(spark, sf), 3)


@register("tel_10_first_five_outputs", sql=_MSG_SQL + """
SELECT job_id, agent_name, seq, k, output, position FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, agent_name ORDER BY seq, k) AS position FROM outs) WHERE position <= 5""")
def tel_10_five(spark, sf):
    return T.first_outputs(_msgs(spark, sf), 5)


@register("tel_10_last_messages", sql=_MSG_SQL + """
SELECT job_id, agent_name, seq, content, position FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, agent_name ORDER BY seq DESC) AS position FROM agent_messages) WHERE position <= 3""")
def tel_10_last_messages(spark, sf):
    """The last three messages of each agent of a job, newest first."""
    m = top_k(_msgs(spark, sf), ["job_id", "agent_name"], [F.desc("seq")], 3, out="position")
    return m.select("job_id", "agent_name", "seq", "content", F.col("position").cast("bigint").alias("position"))


@register("tel_10_last_output", sql=_MSG_SQL + """
SELECT job_id, agent_name, arg_max(output, seq * 10 + k) AS last_output FROM outs GROUP BY job_id, agent_name""")
def tel_10_last(spark, sf):
    return T.last_output(_msgs(spark, sf))


@register("tel_11_agent_efficiency", sql=_MSG_SQL + """
SELECT job_id, agent_name, round(messages / greatest(exec_time / 60, 1.0), 6) AS messages_per_minute,
  round(tokens / greatest(messages, 1), 6) AS tokens_per_message, round(errors / greatest(messages, 1), 6) AS error_rate
FROM contrib""")
def tel_11(spark, sf):
    p = T.agent_performance(T.agent_contributions(_msgs(spark, sf), _stats(spark, sf)))
    return p.select("job_id", "agent_name", *[F.round(c, 6).alias(c) for c in
                                              ("messages_per_minute", "tokens_per_message", "error_rate")])


@register("tel_12_agent_rating", sql=_MSG_SQL + """
SELECT job_id, agent_name, CASE WHEN messages = 0 THEN 'No Activity'
  WHEN key_outputs / messages - errors / messages >= 0.3 THEN 'Excellent'
  WHEN key_outputs / messages - errors / messages >= 0.15 THEN 'Good'
  WHEN key_outputs / messages - errors / messages >= 0 THEN 'Fair' ELSE 'Needs Improvement' END AS performance_rating
FROM contrib""")
def tel_12(spark, sf):
    p = T.agent_performance(T.agent_contributions(_msgs(spark, sf), _stats(spark, sf)))
    return p.select("job_id", "agent_name", "performance_rating")


@register("tel_13_process_flow", sql=_MSG_SQL + """
, dim AS (SELECT * FROM (VALUES (1, 'DataProcessorAgent', 'Data analysis and preprocessing'),
    (2, 'ModelBuilderAgent', 'Machine learning model creation'), (3, 'CodeExecutorAgent', 'Script execution and validation'),
    (4, 'AnalystAgent', 'Quality assurance and validation'), (5, 'PredictionAgent', 'Prediction generation'),
    (6, 'VisualizationAgent', 'Chart and visualization creation')) AS t(step, agent_name, role))
, firsts AS (SELECT job_id, agent_name, string_agg(output, ' | ' ORDER BY position) AS key_deliverables FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, agent_name ORDER BY seq, k) AS position FROM outs) WHERE position <= 2
    GROUP BY job_id, agent_name)
SELECT c.job_id, d.step, c.agent_name, d.role, c.exec_time AS duration,
  CASE WHEN errors = 0 THEN 'High' WHEN errors < 3 THEN 'Medium' ELSE 'Low' END AS output_quality, f.key_deliverables
FROM contrib c JOIN dim d ON c.agent_name = d.agent_name LEFT JOIN firsts f ON c.job_id = f.job_id AND c.agent_name = f.agent_name""")
def tel_13(spark, sf):
    m = _msgs(spark, sf)
    return T.process_flow(T.agent_contributions(m, _stats(spark, sf)), T.first_outputs(m, 2))


@register("tel_14_15_16_job_scores", sql=_MSG_SQL + """
, g AS (SELECT job_id, sum(messages) AS msgs, sum(errors) AS errs, sum(key_outputs) AS outs, count(*) AS agents,
               count(*) FILTER (WHERE key_outputs > 0) AS with_out FROM contrib GROUP BY job_id)
SELECT job_id, CASE WHEN agents = 0 THEN 0.0 ELSE round(greatest(0.0, 100 - errs / greatest(msgs, 1) * 50), 2) END AS efficiency_score,
  CASE WHEN outs + errs = 0 THEN 0.0 ELSE round(outs / (outs + errs) * 100, 2) END AS success_rate,
  CASE WHEN agents = 0 THEN 'No Data' WHEN with_out / agents >= 0.8 THEN 'Excellent' WHEN with_out / agents >= 0.6 THEN 'Good'
       WHEN with_out / agents >= 0.4 THEN 'Fair' ELSE 'Poor' END AS collaboration_quality
FROM g""")
def tel_14_16(spark, sf):
    return T.job_scores(T.agent_contributions(_msgs(spark, sf), _stats(spark, sf)))


# fixed values (must equal the reference's): report texts
_SUMMARY_UNSUP = "Unsupervised anomaly detection pipeline completed successfully. {n} models trained for fraud detection using Isolation Forest algorithm."
_SUMMARY_SUP = "Supervised machine learning pipeline completed. {n} models trained using H2O AutoML for prediction task."


@register("tel_17_job_report", sql=_MSG_SQL.replace("WITH ", "WITH " + V.SQL["jobs"].join(["jobs AS (", "),\n"]) +
                                                      V.SQL["models"].join(["models AS (", "),\n"]), 1) + """
, g AS (SELECT job_id, sum(messages) AS msgs, sum(errors) AS errs, sum(key_outputs) AS outs, sum(exec_time) AS total_time,
               sum(tokens) AS total_tokens, count(*) AS agents FROM contrib GROUP BY job_id)
, nm AS (SELECT job_id, count(*) AS n_models FROM models GROUP BY job_id)
SELECT g.job_id, j.name AS job_name, g.total_time AS total_execution_time, CAST(g.msgs AS BIGINT) AS total_messages, CAST(g.total_tokens AS BIGINT) AS total_tokens,
  g.agents AS agents_involved, coalesce(nm.n_models, 0) AS models_generated,
  CASE WHEN j.target_column IS NULL OR trim(j.target_column) = '' THEN 'unsupervised' ELSE 'supervised' END AS learning_type,
  j.target_column,
  CASE WHEN j.target_column IS NULL OR trim(j.target_column) = ''
       THEN 'Unsupervised anomaly detection pipeline completed successfully. ' || CAST(coalesce(nm.n_models, 0) AS VARCHAR) || ' models trained for fraud detection using Isolation Forest algorithm.'
       ELSE 'Supervised machine learning pipeline completed. ' || CAST(coalesce(nm.n_models, 0) AS VARCHAR) || ' models trained using H2O AutoML for prediction task.' END AS executive_summary,
  CASE WHEN g.errs > 0 THEN 'Resolved ' || CAST(g.errs AS VARCHAR) || ' errors during execution' END AS challenges
FROM g JOIN jobs j ON g.job_id = j.id LEFT JOIN nm ON g.job_id = nm.job_id""")
def tel_17(spark, sf):
    """Job report: totals, learning type, models, summary and challenge texts."""
    t = _t(spark, sf)
    c = T.agent_contributions(_msgs(spark, sf), _stats(spark, sf))
    g = c.groupBy("job_id").agg(F.sum("messages").alias("msgs"), F.sum("errors").alias("errs"),
                                F.sum("exec_time").alias("total_time"), F.sum("tokens").alias("total_tokens"),
                                F.count(F.lit(1)).alias("agents"))
    nm = V.models(t.lineitem).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_models"))
    j = V.jobs(t.orders).select(F.col("id").alias("job_id"), F.col("name").alias("job_name"), "target_column")
    r = g.join(j, "job_id").join(nm, "job_id", "left").withColumn("n", F.coalesce("n_models", F.lit(0)))
    unsup = F.col("target_column").isNull() | (F.trim("target_column") == "")
    pre_u, post_u = _SUMMARY_UNSUP.split("{n}")
    pre_s, post_s = _SUMMARY_SUP.split("{n}")
    summ = F.when(unsup, F.concat(F.lit(pre_u), F.col("n").cast("string"), F.lit(post_u))).otherwise(
        F.concat(F.lit(pre_s), F.col("n").cast("string"), F.lit(post_s)))
    return r.select("job_id", "job_name", F.col("total_time").alias("total_execution_time"),
                    F.col("msgs").alias("total_messages"), F.col("total_tokens").cast("bigint").alias("total_tokens"),
                    F.col("agents").alias("agents_involved"), F.col("n").alias("models_generated"),
                    F.when(unsup, F.lit("unsupervised")).otherwise(F.lit("supervised")).alias("learning_type"),
                    "target_column", summ.alias("executive_summary"),
                    F.when(F.col("errs") > 0, F.concat(F.lit("Resolved "), F.col("errs").cast("string"),
                                                      F.lit(" errors during execution"))).alias("challenges"))


def _by_type(texts: dict, having: str = "TRUE") -> str:
    one = {k: " | ".join(v) if isinstance(v, list) else v for k, v in texts.items()}
    return f"CASE WHEN {having} THEN CASE WHEN learning_type = 'unsupervised' THEN '{one['unsupervised']}' ELSE '{one['supervised']}' END END"


@register("tel_17_report_blocks", sql=_MSG_SQL.replace("WITH ", "WITH " + V.SQL["jobs"].join(["jobs AS (", "),\n"]) +
                                                         V.SQL["models"].join(["models AS (", "),\n"]), 1) + f"""
, lo AS (SELECT job_id, agent_name, arg_max(output, seq * 10 + k) AS last_output FROM outs GROUP BY job_id, agent_name)
, c AS (SELECT contrib.*, lo.last_output FROM contrib LEFT JOIN lo ON contrib.job_id = lo.job_id AND contrib.agent_name = lo.agent_name)
, g AS (SELECT job_id, sum(errors) AS errs,
    max(CASE WHEN agent_name = 'DataProcessorAgent' THEN messages END) AS data_messages, max(CASE WHEN agent_name = 'DataProcessorAgent' THEN warnings END) AS data_quality_issues,
    max(CASE WHEN agent_name = 'ModelBuilderAgent' THEN messages END) AS training_attempts, max(CASE WHEN agent_name = 'ModelBuilderAgent' THEN errors END) AS training_errors,
    max(CASE WHEN agent_name = 'ModelBuilderAgent' THEN coalesce(last_output, 'None') END) AS final_model_details,
    max(CASE WHEN agent_name = 'PredictionAgent' THEN key_outputs END) AS prediction_tasks, max(CASE WHEN agent_name = 'PredictionAgent' THEN errors = 0 END) AS prediction_success,
    max(CASE WHEN agent_name = 'VisualizationAgent' THEN key_outputs END) AS charts_generated, max(CASE WHEN agent_name = 'VisualizationAgent' THEN errors = 0 END) AS visualization_success
  FROM c GROUP BY job_id)
, df AS (SELECT job_id, string_agg(output, ' | ' ORDER BY p) AS data_findings FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq, k) AS p FROM outs
         WHERE agent_name = 'DataProcessorAgent') WHERE p <= 3 GROUP BY job_id)
, pd AS (SELECT job_id, string_agg(output, ' | ' ORDER BY seq, k) AS prediction_details FROM outs WHERE agent_name = 'PredictionAgent' GROUP BY job_id)
, nm AS (SELECT job_id, count(*) AS n FROM models GROUP BY job_id)
, t AS (SELECT g.*, df.data_findings, pd.prediction_details, coalesce(nm.n, 0) AS models_generated,
               CASE WHEN j.target_column IS NULL OR trim(j.target_column) = '' THEN 'unsupervised' ELSE 'supervised' END AS learning_type
        FROM g LEFT JOIN jobs j ON g.job_id = j.id LEFT JOIN nm ON g.job_id = nm.job_id LEFT JOIN df ON g.job_id = df.job_id LEFT JOIN pd ON g.job_id = pd.job_id)
SELECT job_id, learning_type, models_generated, concat_ws(' | ', CASE WHEN models_generated > 0 THEN '{T.TRAINED_TEXT[0]}' || CAST(models_generated AS VARCHAR) || '{T.TRAINED_TEXT[1]}' END,
    CASE WHEN errs = 0 THEN '{T.NO_ERRORS_TEXT}' END) AS achievements,
  concat_ws(' | ', CASE WHEN errs > 0 THEN '{T.RESOLVED_TEXT[0]}' || CAST(errs AS VARCHAR) || '{T.RESOLVED_TEXT[1]}' END) AS challenges, {_by_type(T.RECOMMENDATIONS)} AS recommendations,
  data_messages, data_findings, data_quality_issues, training_attempts, training_errors, final_model_details, {_by_type(T.TRAINING_APPROACH, 'training_attempts IS NOT NULL')} AS training_approach,
  prediction_tasks, prediction_success, prediction_details, charts_generated, {_by_type(T.CHART_TYPE, 'charts_generated IS NOT NULL')} AS visualization_type, visualization_success FROM t""")
def tel_17_blocks(spark, sf):
    """The report's lists and detail blocks of every job (lists joined by ' | ')."""
    t, m = _t(spark, sf), _msgs(spark, sf)
    r = T.report_blocks(m, T.agent_contributions(m, _stats(spark, sf)), V.jobs(t.orders), V.models(t.lineitem))
    for c in ("achievements", "challenges", "recommendations", "data_findings"):
        r = r.withColumn(c, F.array_join(c, " | "))
    return r


_RUN_SQL = V.with_views("agent_events") + """
, pa AS (SELECT job_id, agent_name, count(*) AS cnt, min(ts) AS first_ts, min(event_id) FILTER (WHERE TRUE) AS dummy,
                arg_min(event_id, (ts, event_id)) AS first_id FROM agent_events GROUP BY job_id, agent_name)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY cnt DESC, first_ts, first_id) AS r_most,
                       row_number() OVER (PARTITION BY job_id ORDER BY cnt, first_ts, first_id) AS r_least FROM pa)
, bal AS (SELECT job_id, count(*) AS n_agents, stddev_pop(cnt) AS sd, avg(cnt) AS mean,
                 max(CASE WHEN r_most = 1 THEN agent_name END) AS most_active_agent,
                 max(CASE WHEN r_least = 1 THEN agent_name END) AS least_active_agent FROM ranked GROUP BY job_id)
, tot AS (SELECT job_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS t FROM agent_events GROUP BY job_id)
, j AS (SELECT tot.*, bal.n_agents, bal.most_active_agent, bal.least_active_agent,
               CASE WHEN n_agents <= 1 THEN 1.0 ELSE least(5.0, greatest(1.0, 5 - sd / greatest(mean, 1.0))) END AS balance_factor
        FROM tot JOIN bal USING (job_id))
"""


@register("tel_18_19_20_run_metrics", sql=_RUN_SQL + """
SELECT job_id, n, round(t, 3) AS execution_time, n_agents, round(balance_factor, 6) AS balance_factor,
  round(least(100.0, (greatest(1.0, 300 / greatest(t, 1.0)) + greatest(1.0, 50 / greatest(n, 1)) + balance_factor) * 10), 1) AS efficiency_score,
  most_active_agent, least_active_agent, round(n / greatest(t / 60, 0.1), 2) AS messages_per_minute,
  round(t / greatest(n, 1), 2) AS average_message_interval FROM j""")
def tel_18_20(spark, sf):
    return T.run_metrics(_events(spark, sf)).withColumn("execution_time", F.round("execution_time", 3))


@register("tel_21_speaker_transitions", sql=V.with_views("agent_messages") + """
SELECT a.job_id, a.seq, p.agent_name AS agent_name_prev, a.agent_name FROM agent_messages a
JOIN agent_messages p ON a.job_id = p.job_id AND p.seq = a.seq - 1 WHERE p.agent_name <> a.agent_name""")
def tel_21(spark, sf):
    return T.transitions(_msgs(spark, sf)).select("job_id", "seq", "agent_name_prev", "agent_name")


@register("tel_22_progress_milestones", dates=["ts"], sql=V.with_views("agent_events") + """
SELECT job_id, rn, ts, status, progress FROM (
  SELECT job_id, ts, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM agent_events) e
JOIN (VALUES (5, 'analyzing_data', 55), (10, 'training_model', 65), (15, 'generating_predictions', 80), (20, 'finalizing', 90))
  AS m(rn, status, progress) USING (rn)""")
def tel_22(spark, sf):
    return T.milestones(_events(spark, sf))


@register("tel_23_version_listing", sql=V.with_views("jobs") + """
SELECT family, id, version_number, is_parent, coalesce(max(version_number) OVER (PARTITION BY family), 1) + 1 AS next_version
FROM jobs""")
def tel_23(spark, sf):
    j = _jobs(spark, sf, with_version=True)
    nxt = j.groupBy("family").agg((F.coalesce(F.max("version_number"), F.lit(1)) + 1).alias("next_version"))
    return j.select("family", "id", "version_number", "is_parent").join(nxt, "family")


@register("tel_24_latest_report", dates=["created_at"], sql=V.with_views("exec_logs") + """
SELECT job_id, stage, arg_max(run_id, (ts, run_id)) AS run_id, max(ts) AS created_at FROM (
  SELECT *, CASE WHEN contains(lower(script_name), 'train') OR contains(lower(script_name), 'model') THEN 'training'
     WHEN contains(lower(script_name), 'predict') THEN 'prediction'
     WHEN contains(lower(script_name), 'visual') OR contains(lower(script_name), 'plot') THEN 'visualization'
     WHEN contains(lower(script_name), 'preprocess') OR contains(lower(script_name), 'clean') THEN 'preprocessing'
     WHEN contains(lower(script_name), 'analys') THEN 'analysis' ELSE 'unknown' END AS stage FROM exec_logs)
GROUP BY job_id, stage""")
def tel_24(spark, sf):
    r = V.exec_logs(_t(spark, sf).events).withColumn("stage", T.script_class(F.col("script_name")))
    return r.groupBy("job_id", "stage").agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id"),
                                            F.max("ts").alias("created_at"))


@register("tel_25_version_comparison", sql=V.with_views("jobs", "models", "agent_statistics") + """
, mc AS (SELECT job_id, count(*) AS model_count, string_agg(name, ',' ORDER BY name) AS model_names FROM models GROUP BY job_id)
, st AS (SELECT job_id, string_agg(agent_name || ':' || CAST(calls AS VARCHAR) || ':' || CAST(tokens AS VARCHAR), ';' ORDER BY agent_name) AS agent_statistics
         FROM (SELECT job_id, agent_name, sum(calls_count) AS calls, sum(tokens_consumed) AS tokens FROM agent_statistics GROUP BY ALL) GROUP BY job_id)
SELECT j.family, j.id AS job_id, j.version_number, j.status,
  CASE WHEN length(j.prompt) > 100 THEN substr(j.prompt, 1, 100) || '...' ELSE j.prompt END AS prompt,
  coalesce(mc.model_count, 0) AS model_count, mc.model_names, st.agent_statistics
FROM jobs j LEFT JOIN mc ON j.id = mc.job_id LEFT JOIN st ON j.id = st.job_id""")
def tel_25(spark, sf):
    """Versions of every family with model counts, sorted model names and
    per-agent statistics (one join + aggregation instead of a query per version)."""
    t = _t(spark, sf)
    j = V.jobs(t.orders, with_version=True)
    # a job may hold a third of all models: names are numbered, then joined chunk by chunk
    mc = ordered_text(V.models(t.lineitem).select("job_id", "name"), ["job_id"], ["name"], "name", ",", "model_names") \
        .withColumnRenamed("n", "model_count")
    st = (_stats(spark, sf).groupBy("job_id", "agent_name")
          .agg(F.sum("calls_count").alias("calls"), F.sum("tokens_consumed").alias("tokens"))
          .groupBy("job_id").agg(F.concat_ws(";", F.array_sort(F.collect_list(
              F.concat_ws(":", "agent_name", F.col("calls").cast("string"), F.col("tokens").cast("string"))))).alias("agent_statistics")))
    prompt = F.when(F.length("prompt") > 100, F.concat(F.substring("prompt", 1, 100), F.lit("..."))).otherwise(F.col("prompt"))
    return (j.join(mc, j.id == mc.job_id, "left").drop(mc.job_id).join(st, j.id == st.job_id, "left")
            .select("family", F.col("id").alias("job_id"), "version_number", "status", prompt.alias("prompt"),
                    F.coalesce("model_count", F.lit(0)).alias("model_count"), "model_names", "agent_statistics"))


@register("tel_26_input_requests", sql=V.with_views("agent_messages") + """
SELECT job_id, count(*) AS input_requests FROM agent_messages
WHERE regexp_matches(content, '(?i)(Enter your response:|Please provide|I need your input|Could you help me|What would you like|Please specify|How would you like to proceed|Do you want me to|Should I proceed|Would you like me to|USER_INPUT_REQUIRED|WAITING_FOR_USER|Please clarify)')
GROUP BY job_id""")
def tel_26(spark, sf):
    m = _msgs(spark, sf)
    return m.where(T.input_request(F.col("content"))).groupBy("job_id").agg(F.count(F.lit(1)).alias("input_requests"))


@register("tel_27_message_filter", sql=V.with_views("agent_messages") + """
SELECT job_id, count(*) AS visible_messages FROM agent_messages
WHERE NOT (regexp_matches(coalesce(agent_name, ''), '(?i)(Pipeline|AgentEvent|ScriptCapture|Event)')
        OR regexp_matches(coalesce(content, ''), '(?i)(Pipeline|AgentEvent|ScriptCapture|Event)'))
GROUP BY job_id""")
def tel_27(spark, sf):
    m = _msgs(spark, sf)
    return m.where(~T.hidden_message(F.col("agent_name"), F.col("content"))).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("visible_messages"))


_STEP_SQL = V.with_views("agent_events") + """
, steps AS (SELECT job_id, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 'Starting step: ' || agent_name
                                      ELSE 'Completed step: ' || agent_name || ' in 0.00s' END AS message FROM agent_events)
, dur AS (SELECT job_id, regexp_extract(message, '^(Starting|Completed) step: (\\w+)', 2) AS step,
                 min(ts) FILTER (WHERE starts_with(message, 'Starting step: ')) AS started,
                 max(ts) FILTER (WHERE starts_with(message, 'Completed step: ')) AS completed
          FROM steps GROUP BY 1, 2)
"""


def _steps(spark, sf):
    e = _events(spark, sf)
    msg = F.when(F.pmod("event_id", F.lit(2)) == 0, F.concat(F.lit("Starting step: "), "agent_name")).otherwise(
        F.concat(F.lit("Completed step: "), "agent_name", F.lit(" in 0.00s")))
    s = e.select("job_id", "ts", "event_id", msg.alias("message"))
    return (s.groupBy("job_id", F.regexp_extract("message", r"^(Starting|Completed) step: (\w+)", 2).alias("step"))
            .agg(F.min(F.when(F.col("message").startswith("Starting step: "), F.col("ts"))).alias("started"),
                 F.max(F.when(F.col("message").startswith("Completed step: "), F.col("ts"))).alias("completed")))


@register("tel_28_step_durations", sql=_STEP_SQL + """
SELECT job_id, step, CASE WHEN completed >= started THEN round((epoch_us(completed) - epoch_us(started)) / 1e6, 3) END AS duration_s
FROM dur""")
def tel_28(spark, sf):
    d = _steps(spark, sf)
    us = F.timestamp_diff("MICROSECOND", F.col("started"), F.col("completed"))
    return d.select("job_id", "step", F.when(F.col("completed") >= F.col("started"), F.round(us / 1e6, 3)).alias("duration_s"))


@register("tel_29_30_31_39_execution_logs", sql=V.with_views("exec_logs") + """
SELECT run_id, job_id, script_name,
  CASE WHEN contains(lower(script_name), 'train') OR contains(lower(script_name), 'model') THEN 'training'
       WHEN contains(lower(script_name), 'predict') THEN 'prediction'
       WHEN contains(lower(script_name), 'visual') OR contains(lower(script_name), 'plot') THEN 'visualization'
       WHEN contains(lower(script_name), 'preprocess') OR contains(lower(script_name), 'clean') THEN 'preprocessing'
       WHEN contains(lower(script_name), 'analys') THEN 'analysis' ELSE 'unknown' END AS script_class,
  CASE WHEN ok THEN CAST(regexp_extract(output, pat, 1) AS INTEGER) END AS attempt,
  CASE WHEN ok THEN CAST(regexp_extract(output, pat, 1) AS INTEGER) - 1 END AS retries,
  CASE WHEN ok THEN CAST(regexp_extract(output, pat, 3) AS DOUBLE) END AS seconds,
  CASE WHEN ok THEN NULL WHEN contains(output, 'Failed after') OR contains(output, 'attempts exhausted') THEN 'retries_exhausted'
       WHEN regexp_matches(output, mpat) THEN 'missing_module' ELSE 'other_error' END AS failure_class,
  CASE WHEN regexp_matches(output, mpat) THEN trim(regexp_extract(output, mpat, 1)) END AS missing_module,
  exit_code = 0 AND (contains(output, 'ERROR_START:') OR contains(output, 'Traceback') OR regexp_matches(output, '"error"\\s*:')) AS false_success
FROM (SELECT *, regexp_matches(output, pat) AS ok FROM (
  SELECT *, '=== Execution successful \\(attempt (\\d+)/(\\d+)\\) in ([0-9.]+)s ===' AS pat,
            'No module named [''"]?([^''"\\n]+)[''"]?' AS mpat FROM exec_logs))""")
def tel_29_31(spark, sf):
    return T.exec_log_fields(V.exec_logs(_t(spark, sf).events))


@register("tel_32_status_log", sql=V.with_views("agent_events") + """
, s AS (SELECT job_id, ts, event_id, CASE agent_name WHEN 'view' THEN 'analyzing_data' WHEN 'click' THEN 'training_model'
               WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status,
               CASE WHEN agent_name = 'purchase' THEN CAST(floor(seconds) AS BIGINT) END AS progress,
               CASE WHEN agent_name = 'error' THEN 'Error ' || CAST(event_id AS VARCHAR) END AS error_message FROM agent_events)
SELECT job_id, arg_max(status, (ts, event_id)) AS status,
  arg_max(progress, (ts, event_id)) FILTER (WHERE progress IS NOT NULL) AS progress,
  arg_max(error_message, (ts, event_id)) FILTER (WHERE error_message IS NOT NULL) AS error_message
FROM s GROUP BY job_id""")
def tel_32(spark, sf):
    """Status change log, last write wins; optional fields keep their last non-null value."""
    e = _events(spark, sf)
    status = (F.when(F.col("agent_name") == "view", F.lit("analyzing_data"))
              .when(F.col("agent_name") == "click", F.lit("training_model"))
              .when(F.col("agent_name") == "purchase", F.lit("completed"))
              .when(F.col("agent_name") == "error", F.lit("failed")).otherwise(F.lit("processing")))
    s = e.select("job_id", "ts", "event_id", status.alias("status"),
                 F.when(F.col("agent_name") == "purchase", F.floor("seconds").cast("bigint")).alias("progress"),
                 F.when(F.col("agent_name") == "error", F.concat(F.lit("Error "), F.col("event_id").cast("string"))).alias("error_message"))
    order = F.struct("ts", "event_id")
    return s.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("progress", F.when(F.col("progress").isNotNull(), order)).alias("progress"),
        F.max_by("error_message", F.when(F.col("error_message").isNotNull(), order)).alias("error_message"))


@register("tel_33_error_log_view", dates=["ts"], sql=V.with_views("agent_events") + """
SELECT job_id, ts, event_id, message FROM agent_events WHERE level = 'ERROR'""")
def tel_33(spark, sf):
    """ERROR log rows ordered by time.  The level is derived, so the filter is
    also stated on the source column, where it reaches the parquet scan."""
    raw = _t(spark, sf).events.where(F.col("event_type") == "error")
    e = V.agent_events(raw)
    return e.where(F.col("level") == "ERROR").orderBy("job_id", "ts", "event_id").select("job_id", "ts", "event_id", "message")


@register("tel_34_report_validity", sql=V.with_views("agent_messages") + f"""
SELECT job_id, count(*) AS reports, count(*) FILTER (WHERE job_id IS NOT NULL AND stage IS NOT NULL AND stage <> '' AND title IS NOT NULL AND title <> ''
    AND content IS NOT NULL AND content <> '') AS valid_reports FROM (
  SELECT job_id, CASE WHEN agent_name <> 'UserProxy' THEN agent_name END AS stage, {_between_sql('content', 'LOG_START:', 'LOG_END:')} AS title,
    content FROM agent_messages) GROUP BY job_id""")
def tel_34(spark, sf):
    """Reports per job, and those with all four mandatory fields; a user's message has no stage."""
    m = _msgs(spark, sf).select("job_id", F.when(F.col("agent_name") != "UserProxy", F.col("agent_name")).alias("stage"),
                                T.between(F.col("content"), "LOG_START:", "LOG_END:").alias("title"), "content")
    return m.groupBy("job_id").agg(F.count(F.lit(1)).alias("reports"), F.count_if(T.valid_report()).alias("valid_reports"))


@register("tel_35_paged_job_list", dates=["created_at"], sql=V.with_views("jobs") + """
SELECT id, status, created_at, (SELECT count(*) FROM jobs WHERE status = 'completed') AS total
FROM jobs WHERE status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50""")
def tel_35(spark, sf):
    """Filtered, paged list (page 2 of 50) plus the filtered total."""
    j = _jobs(spark, sf).where(F.col("status") == "completed")
    total = one_row(j.agg(F.count(F.lit(1)).alias("total")))["total"]
    page = j.orderBy(F.desc("created_at"), F.desc("id")).offset(50).limit(50).select("id", "status", "created_at")
    return page.withColumn("total", total)


@register("tel_36_dedup_messages", sql=V.with_views("agent_messages") + """
SELECT count(*) AS stored, (SELECT count(*) FROM (SELECT DISTINCT job_id, agent_name, content, ts_s FROM agent_messages)) AS distinct_messages
FROM (SELECT * FROM agent_messages UNION ALL SELECT * FROM agent_messages)""")
def tel_36(spark, sf):
    """Each message is stored twice; de-duplication on (job, agent, text, second)."""
    m = _msgs(spark, sf)
    twice = m.unionByName(m)
    d = twice.dropDuplicates(["job_id", "agent_name", "content", "ts_s"])
    distinct = one_row(d.agg(F.count(F.lit(1)).alias("n")))["n"]
    return twice.agg(F.count(F.lit(1)).alias("stored"), F.first(distinct).alias("distinct_messages"))


_INV_SQL = V.with_views("jobs", "models", "exec_logs") + """
, cls AS (SELECT job_id, exit_code, CASE WHEN contains(lower(script_name), 'train') OR contains(lower(script_name), 'model') THEN 'training'
       WHEN contains(lower(script_name), 'predict') THEN 'prediction'
       WHEN contains(lower(script_name), 'visual') OR contains(lower(script_name), 'plot') THEN 'visualization' ELSE 'other' END AS c FROM exec_logs)
, f AS (SELECT job_id, bool_or(c = 'visualization' AND exit_code = 0) AS has_plot,
               bool_or(c = 'prediction' AND exit_code = 0) AS has_predictions FROM cls GROUP BY job_id)
, mc AS (SELECT job_id, count(*) AS model_files FROM models GROUP BY job_id)
, inv AS (SELECT j.id AS job_id, coalesce(f.has_plot, false) AS has_plot, coalesce(f.has_predictions, false) AS has_predictions,
                 coalesce(mc.model_files, 0) AS model_files
          FROM jobs j LEFT JOIN f ON j.id = f.job_id LEFT JOIN mc ON j.id = mc.job_id)
"""


def _inventory(spark, sf):
    t = _t(spark, sf)
    lg = V.exec_logs(t.events).withColumn("c", T.script_class(F.col("script_name")))
    f = lg.groupBy("job_id").agg(
        F.bool_or((F.col("c") == "visualization") & (F.col("exit_code") == 0)).alias("has_plot"),
        F.bool_or((F.col("c") == "prediction") & (F.col("exit_code") == 0)).alias("has_predictions"))
    mc = V.models(t.lineitem).groupBy("job_id").agg(F.count(F.lit(1)).alias("model_files"))
    j = V.jobs(t.orders).select(F.col("id").alias("job_id"))
    return (j.join(f, "job_id", "left").join(mc, "job_id", "left")
            .select("job_id", F.coalesce("has_plot", F.lit(False)).alias("has_plot"),
                    F.coalesce("has_predictions", F.lit(False)).alias("has_predictions"),
                    F.coalesce("model_files", F.lit(0)).alias("model_files")))


@register("tel_37_results_inventory", sql=_INV_SQL + "SELECT * FROM inv")
def tel_37(spark, sf):
    return _inventory(spark, sf)


@register("tel_38_extended_metrics", sql=_RUN_SQL.replace("WITH ", "WITH " + V.SQL["models"].join(["models AS (", "),\n"]), 1) + """
, fam AS (SELECT id, job_id, name FROM models)
SELECT j.job_id, fam.id AS model_id, fam.name AS model_name,
  CASE WHEN lower(fam.name) LIKE '%gbm%' THEN 'Gradient Boosting Machine (GBM)'
            WHEN lower(fam.name) LIKE '%randomforest%' OR lower(fam.name) LIKE '%rf%' THEN 'Random Forest'
            WHEN lower(fam.name) LIKE '%xgboost%' THEN 'XGBoost'
            WHEN lower(fam.name) LIKE '%glm%' THEN 'Generalized Linear Model (GLM)'
            WHEN lower(fam.name) LIKE '%drf%' THEN 'Distributed Random Forest'
            WHEN lower(fam.name) LIKE '%deeplearning%' OR lower(fam.name) LIKE '%dl%' THEN 'Deep Learning'
            WHEN lower(fam.name) LIKE '%naivebayes%' THEN 'Naive Bayes'
            WHEN lower(fam.name) LIKE '%stackedensemble%' THEN 'Stacked Ensemble' ELSE 'Unknown' END AS model_algorithm,
  j.n AS total_agent_messages, j.n_agents AS agents_used, j.most_active_agent, j.least_active_agent,
  round(j.t, 2) AS training_duration_seconds, round(j.t / 60, 2) AS training_duration_minutes,
  round(j.n / greatest(j.t / 60, 0.1), 2) AS messages_per_minute, round(j.t / greatest(j.n, 1), 2) AS average_message_interval,
  round(least(100.0, (greatest(1.0, 300 / greatest(j.t, 1.0)) + greatest(1.0, 50 / greatest(j.n, 1)) + j.balance_factor) * 10), 1) AS efficiency_score
FROM j LEFT JOIN fam ON j.job_id = fam.job_id""")
def tel_38(spark, sf):
    """One wide row per model of a job (one for a job without models) merging
    model metadata and run metrics."""
    t = _t(spark, sf)
    r = T.run_metrics(_events(spark, sf))
    fam = V.models(t.lineitem).select(F.col("id").alias("model_id"), "job_id", F.col("name").alias("model_name"))
    alg, _f, _l = M.model_family(F.col("model_name"))
    j = r.join(fam, "job_id", "left")
    return j.select("job_id", "model_id", "model_name", F.when(F.col("model_name").isNull(), F.lit("Unknown")).otherwise(alg).alias("model_algorithm"),
                    F.col("n").alias("total_agent_messages"), F.col("n_agents").alias("agents_used"),
                    "most_active_agent", "least_active_agent",
                    F.round("execution_time", 2).alias("training_duration_seconds"),
                    F.round(F.col("execution_time") / 60, 2).alias("training_duration_minutes"),
                    "messages_per_minute", "average_message_interval", "efficiency_score")


def _fixed_sql(*groups: dict) -> str:
    return ", ".join(f"{str(v).lower()} AS {k}" if isinstance(v, bool) else f"'{v}' AS {k}" for g in groups for k, v in g.items())


def _family_sql(column: int) -> str:
    ladder = " ".join(f"WHEN {' OR '.join(f"contains(lower(nm), '{t}')" for t in row[0])} THEN '{row[column]}'" for row in M.FAMILY_LADDER)
    return f"CASE {ladder} ELSE 'Unknown' END"


_DESCRIPTION_SQL = ("CASE model_algorithm " + " ".join(f"WHEN '{a}' THEN '{d}'" for a, d in M.FAMILY_DESCRIPTIONS.items()) + f" ELSE '{M.UNKNOWN_DESCRIPTION}' END"
                    + f" || CASE WHEN is_automl_leader THEN '{M.LEADER_SUFFIX}' ELSE '' END")


@register("tel_38_metric_groups", sql=_RUN_SQL.replace("WITH ", "WITH " + "".join(V.SQL[v].join([f"{v} AS (", "),\n"]) for v in ("models", "jobs", "agent_messages")), 1) + f"""
, part AS (SELECT job_id, string_agg(agent_name || '=' || CAST(cnt AS VARCHAR), ', ' ORDER BY agent_name) AS agent_participation FROM pa GROUP BY job_id)
, ctx AS (SELECT job_id, bool_or(coalesce({_between_sql('content', 'MODEL_PATH_START:', ':MODEL_PATH_END')}, '') <> '') AS path FROM agent_messages GROUP BY job_id)
, w AS (SELECT j.*, mo.id AS model_id, mo.name AS model_name, mo.model_path, mo.metrics, coalesce(mo.name, '') AS nm, part.agent_participation, ctx.job_id IS NOT NULL AS has_ctx,
               coalesce(ctx.path, false) AS path, jb.target_column
        FROM j JOIN part ON j.job_id = part.job_id LEFT JOIN models mo ON j.job_id = mo.job_id LEFT JOIN ctx ON j.job_id = ctx.job_id LEFT JOIN jobs jb ON j.job_id = jb.id)
, f AS (SELECT *, {_family_sql(1)} AS model_algorithm, {_family_sql(2)} AS model_family, contains(lower(nm), 'leader') AS is_automl_leader FROM w)
SELECT job_id, model_id, model_name, model_path, {_fixed_sql(T.MODEL_ORIGIN, T.PROCESS_METRICS, T.DATASET_METRICS)}, model_algorithm, model_family, {_DESCRIPTION_SQL} AS model_description,
  is_automl_leader, target_column, strlen(metrics) AS file_size_bytes, round(strlen(metrics) / (1024 * 1024), 2) AS file_size_mb,
  round(t, 2) AS training_duration_seconds, round(t / 60, 2) AS training_duration_minutes, n AS total_agent_messages, n_agents AS agents_used, agent_participation,
  most_active_agent, least_active_agent, round(n / greatest(t / 60, 0.1), 2) AS messages_per_minute, round(t / greatest(n, 1), 2) AS average_message_interval,
  round(least(100.0, (greatest(1.0, 300 / greatest(t, 1.0)) + greatest(1.0, 50 / greatest(n, 1)) + balance_factor) * 10), 1) AS efficiency_score,
  has_ctx AS pipeline_context_available, path AS model_path_detected_automatically,
  {", ".join(f"CAST(regexp_extract(metrics, '\"{c}\": ([0-9.]+)', 1) AS DOUBLE) AS {c}" for c in ("rmse", "mae", "r2", "training_time"))}
FROM (SELECT * REPLACE (nullif(metrics, '') AS metrics) FROM f)""")
def tel_38_groups(spark, sf):
    """All seven metric groups of every model in one wide row."""
    t = _t(spark, sf)
    return T.metric_groups(_events(spark, sf), V.models(t.lineitem), V.jobs(t.orders), _msgs(spark, sf))


@register("tel_40_next_step_decision", sql=_INV_SQL.replace("WITH ", "WITH " + V.SQL["agent_messages"].join(["agent_messages AS (", "),\n"]), 1) + f"""
, mf AS (SELECT job_id, bool_or(mp IS NOT NULL AND mp <> '') AS has_model_path, bool_or(mt IS NOT NULL AND mt <> '') AS has_metrics,
                bool_or(e IS NOT NULL AND e <> '') AS has_errors FROM (
           SELECT job_id, {_between_sql('content', 'MODEL_PATH_START:', ':MODEL_PATH_END')} AS mp,
                  {_between_sql('content', 'METRICS_START:', ':METRICS_END')} AS mt,
                  {_between_sql('content', 'ERROR_START:', ':ERROR_END')} AS e FROM agent_messages) GROUP BY job_id)
SELECT inv.job_id, CASE WHEN (inv.model_files > 0 OR coalesce(mf.has_model_path, false)) AND inv.has_plot THEN 'done'
  WHEN inv.has_predictions AND NOT inv.has_plot THEN 'visualize'
  WHEN (inv.model_files > 0 OR coalesce(mf.has_model_path, false)) AND coalesce(mf.has_metrics, false) THEN 'forward'
  WHEN coalesce(mf.has_errors, false) THEN 'fix' ELSE 'incomplete' END AS decision
FROM inv LEFT JOIN mf ON inv.job_id = mf.job_id""")
def tel_40(spark, sf):
    inv = _inventory(spark, sf)
    m = _msgs(spark, sf)
    c = F.col("content")
    mf = m.groupBy("job_id").agg(
        F.bool_or(F.coalesce(T.between(c, "MODEL_PATH_START:", ":MODEL_PATH_END") != "", F.lit(False))).alias("has_model_path"),
        F.bool_or(F.coalesce(T.between(c, "METRICS_START:", ":METRICS_END") != "", F.lit(False))).alias("has_metrics"),
        F.bool_or(F.coalesce(T.between(c, "ERROR_START:", ":ERROR_END") != "", F.lit(False))).alias("has_errors"))
    j = inv.join(mf, "job_id", "left")
    has_model = (F.col("model_files") > 0) | F.coalesce("has_model_path", F.lit(False))
    d = T.next_step(has_model, F.coalesce("has_metrics", F.lit(False)), F.col("has_predictions"), F.col("has_plot"),
                    F.coalesce("has_errors", F.lit(False)))
    return j.select("job_id", d.alias("decision"))


@register("tel_41_log_query", dates=["ts"], sql=V.with_views("agent_events") + """
SELECT job_id, event_id, ts, message, (SELECT count(*) FROM agent_events WHERE level = 'INFO' AND agent_name = 'click') AS total
FROM agent_events WHERE level = 'INFO' AND agent_name = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def tel_41(spark, sf):
    """Log query by level and agent: the newest 100 plus the total count."""
    raw = _t(spark, sf).events.where(F.col("event_type") == "click")  # reaches the parquet scan
    e = V.agent_events(raw).where((F.col("level") == "INFO") & (F.col("agent_name") == "click"))
    total = one_row(e.agg(F.count(F.lit(1)).alias("total")))["total"]
    return (e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("job_id", "event_id", "ts", "message")
            .withColumn("total", total))


@register("tel_42_stage_board", sql=V.with_views("agent_events") + """
, n AS (SELECT job_id, ts, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM agent_events)
, m AS (SELECT * FROM (VALUES (5, 'analyzing_data', 55), (10, 'training_model', 65), (15, 'generating_predictions', 80),
                              (20, 'finalizing', 90)) AS t(rn, stage, progress))
SELECT a.job_id, m.stage, m.progress, CASE WHEN b.ts IS NULL THEN 'in_progress' ELSE 'completed' END AS stage_status,
  round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 3) AS duration_s
FROM n a JOIN m ON a.rn = m.rn LEFT JOIN n b ON b.job_id = a.job_id AND b.rn = a.rn + 5""")
def tel_42(spark, sf):
    """Stage board: each milestone stage with its status and the time until the next one."""
    n = T.first_events(_events(spark, sf), 25)  # the last milestone and the five events after it
    dim = spark.createDataFrame([(r, s, p) for r, s, p in T.MILESTONES], "rn long, stage string, progress int")
    a = n.join(F.broadcast(dim), "rn")
    b = n.select("job_id", (F.col("rn") - 5).alias("rn"), F.col("ts").alias("next_ts"))
    j = a.join(b, ["job_id", "rn"], "left")
    us = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("next_ts"))
    return j.select("job_id", "stage", "progress",
                    F.when(F.col("next_ts").isNull(), F.lit("in_progress")).otherwise(F.lit("completed")).alias("stage_status"),
                    F.round(us / 1e6, 3).alias("duration_s"))
