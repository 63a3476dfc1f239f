"""Registered queries: Structured Streaming jobs replayed over files (STR-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktab.operators import telemetry as TM
from sparktab.plans import views as V
from sparktab.plans.registry import register
from sparktab.session import checkpoint_path
from sparktab.streaming import streams as ST


def _staged(spark, df, name, order_col, n=5):
    path = checkpoint_path(spark, f"stream-src-{name}")
    width = ST.stage_slices(df, path, order_col, n)
    return path, df.schema, ST.delay(width)


@register("str_01_running_totals", sql=V.with_views("agent_statistics") + """
SELECT job_id, agent_name, tokens_consumed, calls_count, input_tokens, output_tokens FROM agent_statistics""")
def str_01(spark, sf):
    """Per (job, agent) totals kept by a stream in update mode and merged into
    a keyed table; the final table equals the batch statistics."""
    m = V.agent_messages(V.tables(spark, sf).conversations)
    calls = TM.token_estimate(m, ("ts",))
    src, schema, _ = _staged(spark, calls, "calls", "ts")
    return ST.running_totals(spark, src, schema, ["job_id", "agent_name"], [
        F.sum("tokens").cast("bigint").alias("tokens_consumed"), F.count(F.lit(1)).alias("calls_count"),
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens")])


@register("str_02_sequence_state", sql=V.with_views("agent_events") + """
, n AS (SELECT job_id, agent_name, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS position,
               lag(agent_name) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS prev FROM agent_events)
SELECT job_id, 'transition' AS kind, position, prev AS from_agent, agent_name AS to_agent,
       CAST(NULL AS VARCHAR) AS status, CAST(NULL AS INTEGER) AS progress
FROM n WHERE prev IS NOT NULL AND prev <> agent_name
UNION ALL
SELECT job_id, 'milestone', position, NULL, NULL, m.status, m.progress FROM n
JOIN (VALUES (5, 'analyzing_data', 55), (10, 'training_model', 65), (15, 'generating_predictions', 80), (20, 'finalizing', 90))
  AS m(rn, status, progress) ON n.position = m.rn""")
def str_02(spark, sf):
    """Per job state (event count, last agent) across micro-batches: speaker
    transitions and progress milestones; equals the batch TEL-21/22 rules."""
    e = V.agent_events(V.tables(spark, sf).events).select("job_id", "event_id", "ts", "agent_name")
    src, schema, delay = _staged(spark, e.repartition(4), "events-seq", "ts")
    ST.end_of_stream(e, src)
    return ST.sequence_state(spark, src, schema, TM.MILESTONES, delay, max_files=4)


@register("str_03_windowed_counts", dates=["window_start"], sql="""
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value_sum
FROM events GROUP BY 1, 2""")
def str_03(spark, sf):
    """Event counts per hour and type; the watermark lags by one slice."""
    e = V.tables(spark, sf).events.select("event_id", "ts", "event_type", "value")
    src, schema, delay = _staged(spark, e.repartition(4), "events-win", "ts")
    r = ST.windowed_counts(spark, src, schema, "ts", "1 hour", delay, ["event_type"], max_files=4)
    return r.withColumn("value_sum", F.round("value_sum", 4))


@register("str_04_score_stream", check="R")
def str_04(spark, sf):
    """A saved k-means pipeline applied to a lineitem stream."""
    from sparktab.operators import ml as ML
    li = V.tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate")
    model = ML.kmeans(li, ["l_quantity", "l_discount"], k=3)
    path = checkpoint_path(spark, "stream-model")
    ML.save_model(model, path)
    src, schema, _ = _staged(spark, li, "lineitem", "l_shipdate", 3)
    scored = ST.score_stream(spark, src, schema, ML.load_model(path))
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
