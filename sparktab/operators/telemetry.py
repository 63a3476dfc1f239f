"""Run-tracking analytics (TEL-*): one query for all jobs at once.

Per-job quantities are aggregations (combined map-side, so a job with a third
of all messages is one partial row per task).  Ordered per-job sequences use
equi-joins on (job, position) or the range-partitioned numbering of
``sequence``; first-k lists use ``profile.top_k``.  Nothing collects an
unbounded group into one task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.operators.models import model_description, model_family
from sparktab.operators.profile import top_k
from sparktab.operators.sequence import ordered_text, seq_lag

# ---------------------------------------------------------------------------
# fixed values (must equal the reference's)
RUNNING_STATUSES = ["processing", "analyzing_data", "training_model", "generating_predictions"]
WAITING_STATUS = "awaiting_user_input"
INPUT_REQUEST_PHRASES = [
    "Enter your response:", "Please provide", "I need your input", "Could you help me",
    "What would you like", "Please specify", "How would you like to proceed", "Do you want me to",
    "Should I proceed", "Would you like me to", "USER_INPUT_REQUIRED", "WAITING_FOR_USER", "Please clarify",
]
HIDDEN_MESSAGE_TERMS = ["Pipeline", "AgentEvent", "ScriptCapture", "Event"]
AGENT_ORDER = ["DataProcessorAgent", "ModelBuilderAgent", "CodeExecutorAgent",
               "AnalystAgent", "PredictionAgent", "VisualizationAgent"]
AGENT_ROLES = {
    "DataProcessorAgent": "Data analysis and preprocessing",
    "ModelBuilderAgent": "Machine learning model creation",
    "CodeExecutorAgent": "Script execution and validation",
    "AnalystAgent": "Quality assurance and validation",
    "PredictionAgent": "Prediction generation",
    "VisualizationAgent": "Chart and visualization creation",
}
MILESTONES = [(5, "analyzing_data", 55), (10, "training_model", 65),
              (15, "generating_predictions", 80), (20, "finalizing", 90)]
# script class by file name, first match wins
SCRIPT_CLASSES = [(("train", "model"), "training"), (("predict",), "prediction"),
                  (("visual", "plot"), "visualization"), (("preprocess", "clean"), "preprocessing"),
                  (("analys",), "analysis")]
# job report: texts by learning type
TRAINING_APPROACH = {"unsupervised": "Isolation Forest", "supervised": "H2O AutoML"}
CHART_TYPE = {"unsupervised": "Anomaly Detection Charts", "supervised": "Forecast Plots"}
RECOMMENDATIONS = {
    "unsupervised": ["Review flagged anomalies for potential fraud investigation", "Consider threshold tuning based on business requirements"],
    "supervised": ["Validate model performance on new data", "Monitor model drift over time"],
}
TRAINED_TEXT = ("Successfully trained ", " machine learning model(s)")
NO_ERRORS_TEXT = "Pipeline completed without critical errors"
RESOLVED_TEXT = ("Resolved ", " errors during execution")
# extended metrics: process and data set groups
PROCESS_METRICS = {"pipeline_version": "v2.0", "framework_used": "H2O AutoML + Autogen", "multi_agent_system": True, "agents_coordination": "SelectorGroupChat",
                   "termination_condition": "MaxMessageTermination(200) | TextMentionTermination", "docker_execution": True}
DATASET_METRICS = {"dataset_processed": True, "dataset_format": "CSV", "preprocessing_applied": True, "feature_engineering": "Automatic (H2O)"}
MODEL_ORIGIN = {"created_by": "H2O AutoML", "model_type": "AutoML"}
# ---------------------------------------------------------------------------


def _strip(c: Column) -> Column:
    """Python-style strip (all leading/trailing whitespace)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def between(text: Column, start: str, end: str) -> Column:
    """TEL-07: first text between ``start`` and the next ``end`` after it,
    stripped; null when either marker is missing."""
    pat = "(?s)" + re.escape(start) + "(.*?)" + re.escape(end)
    return F.when(text.rlike(pat), _strip(F.regexp_extract(text, pat, 1)))


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def message_outputs(messages: DataFrame) -> DataFrame:
    """Per message: error text, key outputs (log, model path, metrics) and the
    warning flag, by the reference's marker rules."""
    t = F.col("content")
    err = between(t, "ERROR_START:", ":ERROR_END")
    log = between(t, "LOG_START:", "LOG_END:")
    mpath = between(t, "MODEL_PATH_START:", ":MODEL_PATH_END")
    met = between(t, "METRICS_START:", ":METRICS_END")
    log_out = F.when(_nonempty(log) & ~t.contains("WARNING"), log)
    mp_out = F.when(_nonempty(mpath), F.concat(F.lit("Model saved: "), mpath))
    met_out = F.when(_nonempty(met), F.concat(F.lit("Metrics generated: "), F.substring(met, 1, 100), F.lit("...")))
    return messages.select(
        "*",
        F.when(_nonempty(err), err).alias("error_text"),
        log_out.alias("out_log"), mp_out.alias("out_model"), met_out.alias("out_metrics"),
        (_nonempty(log_out).cast("int") + _nonempty(mp_out).cast("int") + _nonempty(met_out).cast("int")).alias("n_outputs"),
        F.upper(t).contains("WARNING").alias("is_warning"),
    )


def output_rows(messages: DataFrame) -> DataFrame:
    """One row per key output: (job_id, agent_name, seq, k, output) in the
    order the reference appends them (log, model path, metrics)."""
    m = message_outputs(messages)
    arr = F.array(F.struct(F.lit(1).alias("k"), F.col("out_log").alias("output")),
                  F.struct(F.lit(2).alias("k"), F.col("out_model").alias("output")),
                  F.struct(F.lit(3).alias("k"), F.col("out_metrics").alias("output")))
    return (m.select("job_id", "agent_name", "seq", F.inline(arr))
            .where(F.col("output").isNotNull()))


def agent_contributions(messages: DataFrame, stats: DataFrame) -> DataFrame:
    """TEL-09: per (job, agent): messages, errors, key outputs, warnings,
    left-joined with statistics (zeros when absent)."""
    m = message_outputs(messages)
    c = m.groupBy("job_id", "agent_name").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count("error_text").alias("errors"),
        F.sum("n_outputs").cast("bigint").alias("key_outputs"),
        F.count_if("is_warning").alias("warnings"))
    s = stats.select("job_id", "agent_name", "tokens_consumed", "calls_count", "total_execution_time")
    return (c.join(s, ["job_id", "agent_name"], "left")
            .select("job_id", "agent_name", "messages", "errors", "key_outputs", "warnings",
                    F.coalesce("tokens_consumed", F.lit(0)).cast("bigint").alias("tokens"),
                    F.coalesce("calls_count", F.lit(0)).cast("bigint").alias("calls"),
                    F.coalesce("total_execution_time", F.lit(0.0)).alias("exec_time")))


def agent_performance(contrib: DataFrame) -> DataFrame:
    """TEL-11/12: efficiency ratios and the rating ladder."""
    n = F.col("messages")
    score = F.col("key_outputs") / n - F.col("errors") / n
    rating = (F.when(n == 0, F.lit("No Activity")).when(score >= 0.3, F.lit("Excellent"))
              .when(score >= 0.15, F.lit("Good")).when(score >= 0, F.lit("Fair"))
              .otherwise(F.lit("Needs Improvement")))
    return contrib.select(
        "job_id", "agent_name",
        (n / F.greatest(F.col("exec_time") / 60, F.lit(1.0))).alias("messages_per_minute"),
        (F.col("tokens") / F.greatest(n, F.lit(1))).alias("tokens_per_message"),
        (F.col("errors") / F.greatest(n, F.lit(1))).alias("error_rate"),
        rating.alias("performance_rating"))


def first_outputs(messages: DataFrame, k: int, group=("job_id", "agent_name")) -> DataFrame:
    """TEL-10: the first k key outputs per group, in message order."""
    o = output_rows(messages)
    return top_k(o, list(group), [F.col("seq"), F.col("k")], k, out="position")


def last_output(messages: DataFrame, group=("job_id", "agent_name")) -> DataFrame:
    """TEL-10: the last key output per group (an aggregate, not a list)."""
    o = output_rows(messages)
    return o.groupBy(*group).agg(F.max_by("output", F.struct("seq", "k")).alias("last_output"))


def process_flow(contrib: DataFrame, firsts: DataFrame) -> DataFrame:
    """TEL-13: agents of the fixed order that are present, with role, duration,
    output quality and the first two deliverables (joined text)."""
    spark = contrib.sparkSession
    dim = spark.createDataFrame([(i + 1, a, AGENT_ROLES[a]) for i, a in enumerate(AGENT_ORDER)],
                                "step int, agent_name string, role string")
    deliv = (firsts.where(F.col("position") <= 2).groupBy("job_id", "agent_name")
             .agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("position", "output"))),
                                                  lambda x: x["output"])).alias("key_deliverables")))
    q = (F.when(F.col("errors") == 0, F.lit("High")).when(F.col("errors") < 3, F.lit("Medium")).otherwise(F.lit("Low")))
    return (contrib.join(F.broadcast(dim), "agent_name")  # 6-row dimension
            .join(deliv, ["job_id", "agent_name"], "left")
            .select("job_id", "step", "agent_name", "role", F.col("exec_time").alias("duration"),
                    q.alias("output_quality"), "key_deliverables"))


def job_scores(contrib: DataFrame) -> DataFrame:
    """TEL-14/15/16: efficiency score, success rate, collaboration quality per job."""
    g = contrib.groupBy("job_id").agg(
        F.sum("messages").alias("msgs"), F.sum("errors").alias("errs"), F.sum("key_outputs").alias("outs"),
        F.count(F.lit(1)).alias("agents"), F.count_if(F.col("key_outputs") > 0).alias("agents_with_outputs"))
    eff = F.when(F.col("agents") == 0, F.lit(0.0)).otherwise(
        F.round(F.greatest(F.lit(0.0), 100 - F.col("errs") / F.greatest(F.col("msgs"), F.lit(1)) * 50), 2))
    succ = F.when(F.col("outs") + F.col("errs") == 0, F.lit(0.0)).otherwise(
        F.round(F.col("outs") / (F.col("outs") + F.col("errs")) * 100, 2))
    rate = F.col("agents_with_outputs") / F.col("agents")
    collab = (F.when(F.col("agents") == 0, F.lit("No Data")).when(rate >= 0.8, F.lit("Excellent"))
              .when(rate >= 0.6, F.lit("Good")).when(rate >= 0.4, F.lit("Fair")).otherwise(F.lit("Poor")))
    return g.select("job_id", eff.alias("efficiency_score"), succ.alias("success_rate"),
                    collab.alias("collaboration_quality"))


def learning_type(target: Column) -> Column:
    """A job without a target is unsupervised."""
    return F.when(target.isNull() | (F.trim(target) == ""), F.lit("unsupervised")).otherwise(F.lit("supervised"))


def report_blocks(messages: DataFrame, contrib: DataFrame, jobs: DataFrame, models: DataFrame) -> DataFrame:
    """TEL-17: one row per job with messages: learning type, achievements,
    challenges and recommendations (arrays), and the details of data
    processing, training, prediction and charts, null for an agent that the
    job hasn't.  A job that isn't in ``jobs`` has no target.  Findings are the
    first three outputs; the prediction outputs, of any number, are put
    together by ``ordered_text``."""
    n, errs = F.coalesce("n_models", F.lit(0)), F.col("_errors")

    def of(agent: str, c) -> Column:
        return F.max(F.when(F.col("agent_name") == agent, c))
    per_agent = contrib.join(last_output(messages), ["job_id", "agent_name"], "left")
    ok = F.col("errors") == 0
    per_job = per_agent.groupBy("job_id").agg(
        F.sum("errors").alias("_errors"),
        of("DataProcessorAgent", F.col("messages")).alias("data_messages"), of("DataProcessorAgent", F.col("warnings")).alias("data_quality_issues"),
        of("ModelBuilderAgent", F.col("messages")).alias("training_attempts"), of("ModelBuilderAgent", F.col("errors")).alias("training_errors"),
        of("ModelBuilderAgent", F.coalesce("last_output", F.lit("None"))).alias("final_model_details"),
        of("PredictionAgent", F.col("key_outputs")).alias("prediction_tasks"), of("PredictionAgent", ok).alias("prediction_success"),
        of("VisualizationAgent", F.col("key_outputs")).alias("charts_generated"), of("VisualizationAgent", ok).alias("visualization_success"))
    first = first_outputs(messages.where(F.col("agent_name") == "DataProcessorAgent"), 3).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "output"))).getField("output").alias("data_findings"))
    details = ordered_text(output_rows(messages.where(F.col("agent_name") == "PredictionAgent")), ["job_id"], ["seq", "k"], "output", " | ",
                           out="prediction_details").drop("n")
    counts = models.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_models"))
    j = (per_job.join(jobs.select(F.col("id").alias("job_id"), learning_type(F.col("target_column")).alias("_type")), "job_id", "left")
         .withColumn("learning_type", F.coalesce("_type", F.lit("unsupervised")))
         .join(counts, "job_id", "left").join(first, "job_id", "left").join(details, "job_id", "left"))

    def by_type(texts: dict, having: str | None = None) -> Column:
        def lit(v):
            return F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
        c = F.when(F.col("learning_type") == "unsupervised", lit(texts["unsupervised"])).otherwise(lit(texts["supervised"]))
        return F.when(F.col(having).isNotNull(), c) if having else c

    def told(text: tuple, c: Column) -> Column:
        return F.concat(F.lit(text[0]), c.cast("string"), F.lit(text[1]))
    return j.select(
        "job_id", "learning_type", n.alias("models_generated"),
        F.array_compact(F.array(F.when(n > 0, told(TRAINED_TEXT, n)), F.when(errs == 0, F.lit(NO_ERRORS_TEXT)))).alias("achievements"),
        F.array_compact(F.array(F.when(errs > 0, told(RESOLVED_TEXT, errs)))).alias("challenges"),
        by_type(RECOMMENDATIONS).alias("recommendations"), "data_messages", "data_findings", "data_quality_issues",
        "training_attempts", "training_errors", "final_model_details", by_type(TRAINING_APPROACH, "training_attempts").alias("training_approach"),
        "prediction_tasks", "prediction_success", "prediction_details",
        "charts_generated", by_type(CHART_TYPE, "charts_generated").alias("visualization_type"), "visualization_success")


def metric_groups(events: DataFrame, models: DataFrame, jobs: DataFrame, messages: DataFrame) -> DataFrame:
    """TEL-38: one wide row per model of a run (one for a run without models),
    merging model, training, performance, process, context, data set and
    model-quality metrics.  The quality figures are those stored with the
    model, not estimates; the size is that of its stored metrics text."""
    runs = run_metrics(events)
    part = events.groupBy("job_id", "agent_name").agg(F.count(F.lit(1)).alias("_n")).groupBy("job_id").agg(  # one row per agent of a job
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("agent_name", "_n"))), lambda x: F.concat(x["agent_name"], F.lit("="), x["_n"].cast("string"))), ", ")
        .alias("agent_participation"))
    context = messages.groupBy("job_id").agg(F.bool_or(F.coalesce(between(F.col("content"), "MODEL_PATH_START:", ":MODEL_PATH_END") != "", F.lit(False))).alias("_path"))
    m = models.select("job_id", F.col("id").alias("model_id"), F.col("name").alias("model_name"), "model_path",
                      F.octet_length("metrics").cast("bigint").alias("file_size_bytes"),
                      F.from_json("metrics", "rmse double, mae double, r2 double, training_time double").alias("_q"))
    j = (runs.join(part, "job_id").join(m, "job_id", "left").join(context.withColumn("_has", F.lit(True)), "job_id", "left")
         .join(jobs.select(F.col("id").alias("job_id"), "target_column"), "job_id", "left"))
    name = F.coalesce("model_name", F.lit(""))
    alg, fam, leader = model_family(name)
    t = F.col("execution_time")

    def fixed(group: dict) -> list[Column]:
        return [F.lit(v).alias(k) for k, v in group.items()]
    return j.select(
        "job_id", "model_id", "model_name", "model_path", *fixed(MODEL_ORIGIN), alg.alias("model_algorithm"), fam.alias("model_family"),
        model_description(name).alias("model_description"), leader.alias("is_automl_leader"), "target_column", "file_size_bytes",
        F.round(F.col("file_size_bytes") / (1024 * 1024), 2).alias("file_size_mb"),
        F.round(t, 2).alias("training_duration_seconds"), F.round(t / 60, 2).alias("training_duration_minutes"),
        F.col("n").alias("total_agent_messages"), F.col("n_agents").alias("agents_used"), "agent_participation", "most_active_agent", "least_active_agent",
        "messages_per_minute", "average_message_interval", "efficiency_score", *fixed(PROCESS_METRICS),
        F.coalesce("_has", F.lit(False)).alias("pipeline_context_available"), F.coalesce("_path", F.lit(False)).alias("model_path_detected_automatically"),
        *fixed(DATASET_METRICS), *[F.col(f"_q.{c}").alias(c) for c in ("rmse", "mae", "r2", "training_time")])


def run_metrics(events: DataFrame) -> DataFrame:
    """TEL-18/19/20 per job from the ordered event stream (job_id, agent_name,
    ts): execution time t (seconds, first to last event), message count n,
    balance factor, efficiency, most/least active agent, rates."""
    per_agent = events.groupBy("job_id", "agent_name").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(F.struct("ts", "event_id")).alias("first"))
    bal = per_agent.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_agents"), F.stddev_pop("cnt").alias("sd"), F.avg("cnt").alias("mean"),
        # most active: highest count, ties to the agent that appeared first
        F.min_by("agent_name", F.struct(-F.col("cnt"), F.col("first"))).alias("most_active_agent"),
        F.min_by("agent_name", F.struct("cnt", "first")).alias("least_active_agent"))
    balance = F.when(F.col("n_agents") <= 1, F.lit(1.0)).otherwise(
        F.least(F.lit(5.0), F.greatest(F.lit(1.0), 5 - F.col("sd") / F.greatest(F.col("mean"), F.lit(1.0)))))
    tot = events.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("_us"))
    j = tot.join(bal, "job_id").withColumn("t", F.col("_us") / 1e6).withColumn("balance_factor", balance)
    eff = F.round(F.least(F.lit(100.0), (F.greatest(F.lit(1.0), 300 / F.greatest(F.col("t"), F.lit(1.0)))
                                          + F.greatest(F.lit(1.0), 50 / F.greatest(F.col("n"), F.lit(1)))
                                          + F.col("balance_factor")) * 10), 1)
    return j.select("job_id", "n", F.col("t").alias("execution_time"), "n_agents",
                    F.round("balance_factor", 6).alias("balance_factor"), eff.alias("efficiency_score"),
                    "most_active_agent", "least_active_agent",
                    F.round(F.col("n") / F.greatest(F.col("t") / 60, F.lit(0.1)), 2).alias("messages_per_minute"),
                    F.round(F.col("t") / F.greatest(F.col("n"), F.lit(1)), 2).alias("average_message_interval"))


def transitions(messages: DataFrame) -> DataFrame:
    """TEL-21: speaker changes per job (previous != current), using the dense
    per-job position ``seq`` and an equi-join on (job, seq - 1)."""
    m = messages.select("job_id", "seq", "agent_name")
    j = seq_lag(m, ["job_id"], "seq", ["agent_name"], 1, suffix="_prev")
    return j.where(F.col("agent_name_prev").isNotNull() & (F.col("agent_name_prev") != F.col("agent_name")))


def first_events(events: DataFrame, k: int) -> DataFrame:
    """(job_id, event_id, ts, rn): the first ``k`` events of each job, numbered;
    at most ``k`` rows of a job leave an input partition."""
    n = top_k(events.select("job_id", "event_id", "ts"), ["job_id"], ["ts", "event_id"], k, out="rn")
    return n.withColumn("rn", F.col("rn").cast("bigint"))


def milestones(events: DataFrame) -> DataFrame:
    """TEL-22: status and progress reached at event 5, 10, 15, 20 of each job
    (the first events of a job by ``top_k``, joined with a 4-row dimension)."""
    spark = events.sparkSession
    dim = spark.createDataFrame(MILESTONES, "rn long, status string, progress int")
    return first_events(events, max(m[0] for m in MILESTONES)).join(F.broadcast(dim), "rn").select("job_id", "rn", "ts", "status", "progress")


def script_class(name: Column) -> Column:
    """TEL-31: class of a script by its file name (ordered ladder)."""
    n = F.lower(name)
    out = F.lit("unknown")
    for toks, cls in reversed(SCRIPT_CLASSES):
        cond = None
        for t in toks:
            cond = n.contains(t) if cond is None else (cond | n.contains(t))
        out = F.when(cond, F.lit(cls)).otherwise(out)
    return out


def exec_log_fields(logs: DataFrame) -> DataFrame:
    """TEL-29/30/39: attempt, retries, seconds of a successful run; failure
    class with the missing module; false-success flag."""
    o = F.col("output")
    ok_pat = r"=== Execution successful \(attempt (\d+)/(\d+)\) in ([0-9.]+)s ==="
    ok = o.rlike(ok_pat)
    attempt = F.when(ok, F.regexp_extract(o, ok_pat, 1).cast("int"))
    mod_pat = r"No module named ['\"]?([^'\"\n]+)['\"]?"
    module = F.when(o.rlike(mod_pat), F.trim(F.regexp_extract(o, mod_pat, 1)))
    failure = (F.when(ok, F.lit(None).cast("string"))
               .when(o.contains("Failed after") | o.contains("attempts exhausted"), F.lit("retries_exhausted"))
               .when(module.isNotNull(), F.lit("missing_module"))
               .otherwise(F.lit("other_error")))
    false_success = (F.col("exit_code") == 0) & (o.contains("ERROR_START:") | o.contains("Traceback")
                                                 | o.rlike(r"\"error\"\s*:"))
    return logs.select(
        "run_id", "job_id", "script_name", script_class(F.col("script_name")).alias("script_class"),
        attempt.alias("attempt"), (attempt - 1).alias("retries"),
        F.when(ok, F.regexp_extract(o, ok_pat, 3).cast("double")).alias("seconds"),
        failure.alias("failure_class"), module.alias("missing_module"), false_success.alias("false_success"))


def input_request(text: Column) -> Column:
    """TEL-26: any of the phrases, case-insensitive."""
    return text.rlike("(?i)(" + "|".join(re.escape(p) for p in INPUT_REQUEST_PHRASES) + ")")


def hidden_message(name: Column, text: Column) -> Column:
    """TEL-27: name or text holds one of the hidden terms, any case."""
    pat = "(?i)(" + "|".join(re.escape(t) for t in HIDDEN_MESSAGE_TERMS) + ")"
    return F.coalesce(name, F.lit("")).rlike(pat) | F.coalesce(text, F.lit("")).rlike(pat)


def elapsed(messages: DataFrame) -> DataFrame:
    """TEL-03: each message with the seconds since its job's first message as ``execution_time``."""
    start = messages.groupBy("job_id").agg(F.min("ts_s").alias("_first"))
    return messages.join(start, "job_id").withColumn("execution_time", (F.col("ts_s") - F.col("_first")).cast("double")).drop("_first")


def accumulate_stats(old: DataFrame, delta: DataFrame) -> DataFrame:
    """TEL-03 incremental upsert: union old totals with new calls and
    re-aggregate per (job, agent); calls add 1 per call row."""
    o = old.select("job_id", "agent_name", "tokens_consumed", "calls_count", "input_tokens",
                   "output_tokens", "total_execution_time", "last_updated")
    d = delta.select("job_id", "agent_name", F.col("tokens").alias("tokens_consumed"), F.lit(1).cast("bigint").alias("calls_count"),
                     F.col("input_tokens"), F.col("output_tokens"), F.col("execution_time").alias("total_execution_time"),
                     F.col("ts").alias("last_updated"))
    u = o.unionByName(d)
    return u.groupBy("job_id", "agent_name").agg(
        F.sum("tokens_consumed").alias("tokens_consumed"), F.sum("calls_count").alias("calls_count"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_execution_time").alias("total_execution_time"), F.max("last_updated").alias("last_updated"))


def token_estimate(messages: DataFrame, keep: tuple = ()) -> DataFrame:
    """TEL-05: tokens = floor(chars / 4); input floor(0.7 t), output floor(0.3 t); columns in ``keep`` stay."""
    t = F.floor(F.length("content") / 4)
    return messages.select("job_id", "seq", "agent_name", *keep, t.alias("tokens"),
                           F.floor(t * 0.7).alias("input_tokens"), F.floor(t * 0.3).alias("output_tokens"))


REPORT_FIELDS = ("job_id", "stage", "title", "content")  # mandatory


def valid_report(fields=REPORT_FIELDS) -> Column:
    """TEL-34: no mandatory field is null or empty."""
    ok = F.lit(True)
    for c in fields:
        ok = ok & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return ok


def next_step(has_model: Column, has_metrics: Column, has_predictions: Column, has_plot: Column,
              has_errors: Column) -> Column:
    """TEL-40: decision ladder of the analyst step."""
    return (F.when(has_model & has_plot, F.lit("done"))
            .when(has_predictions & ~has_plot, F.lit("visualize"))
            .when(has_model & has_metrics, F.lit("forward"))
            .when(has_errors, F.lit("fix"))
            .otherwise(F.lit("incomplete")))
