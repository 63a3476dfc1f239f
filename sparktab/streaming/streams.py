"""Structured Streaming jobs (STR-01..04).

All sources are file streams (parquet), all sinks are ``foreachBatch`` writes
into the shared checkpoint folder, and every query keeps its own checkpoint
location there, so a restarted job resumes where it stopped.  With
``trigger(availableNow=True)`` a run processes what is present and ends.

* running_totals  - update-mode aggregation kept as an append-only keyed log
* sequence_state  - per-job state (count, last agent, events held in time
  buckets until the watermark passes them, in ordered chunks) with transformWithState: map state and timers
* windowed_counts - watermark + event-time windows; late rows are dropped
* score_stream    - a saved model applied to a stream

Files of one slice come in any order and in any number of triggers.  The
watermark lags by the slice width (``stage_slices`` returns it), so no row of
a replayed slice is late.  Rows that are late are dropped by Spark and
reported by ``_finish``.
"""

from __future__ import annotations

import heapq
import itertools
import math
import warnings
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sparktab.session import checkpoint_path


def stage_slices(df: DataFrame, path: str, order_col: str, n_slices: int = 5) -> float:
    """Write ``df`` as ``n_slices`` time-ordered parquet folders (oldest first,
    one after the other: a file stream reads by modification time) for a
    replay.  Returns the width of a slice, in seconds for a time column: a
    watermark of that delay loses no row, whatever the files of a trigger."""
    c = F.col(order_col)
    temporal = isinstance(df.schema[order_col].dataType, (T.TimestampType, T.TimestampNTZType))
    if temporal:  # offsets from the minimum, kept inside Spark (no time zone involved)
        from sparktab.operators.sequence import one_row
        lo = one_row(df.agg(F.min(c).alias("lo")))["lo"]
        key = F.timestamp_diff("MICROSECOND", lo, c).cast("double")
        span = df.agg(F.max(key)).first()[0] or 0.0  # one number
        base = 0.0
    else:
        r = df.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()  # one row
        key, base, span = c.cast("double"), r[0], r[1] - r[0]
    width = span / n_slices or 1.0
    sl = F.least(F.floor((key - F.lit(base)) / F.lit(width)), F.lit(n_slices - 1))
    tagged = df.withColumn("_slice", sl)
    for i in range(n_slices):  # n_slices distributed writes, in time order
        tagged.where(F.col("_slice") == i).drop("_slice").write.mode("overwrite").parquet(f"{path}/slice={i:04d}")
    return width / 1e6 if temporal else width


def delay(seconds: float) -> str:
    """Watermark delay that covers a slice of ``seconds``."""
    return f"{math.ceil(seconds) + 1} seconds"


def _finish(query) -> None:
    """Wait for the end; say so if rows came later than the watermark."""
    query.awaitTermination()
    late = sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
    if late:
        warnings.warn(f"{late} rows (or partial groups) were later than the watermark and were dropped", stacklevel=2)


def _merge_keyed(state_dir: str, keys: list[str]):
    """foreachBatch sink for update-mode output: each epoch appends its
    updated rows to its own folder (overwritten if the epoch is replayed, so
    the sink is idempotent).  Writing costs O(batch), never O(table); the
    current table is the latest epoch's row per key (``_latest``)."""
    def write(batch: DataFrame, epoch: int):
        batch.withColumn("_epoch", F.lit(epoch).cast("long")) \
             .write.mode("overwrite").parquet(f"{state_dir}/e{epoch:012d}")
    return write


def _latest(spark: SparkSession, state_dir: str, keys: list[str]) -> DataFrame:
    """Current keyed table: for every key the row of its latest epoch."""
    log = spark.read.option("recursiveFileLookup", "true").parquet(state_dir)
    vals = [c for c in log.columns if c not in keys and c != "_epoch"]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("_epoch")).alias("_v"))
    return latest.select(*keys, "_v.*")


def running_totals(spark: SparkSession, source: str, schema: T.StructType, keys: list[str],
                   aggs: list, name: str = "running_totals", max_files: int = 8) -> DataFrame:
    """STR-01: totals per key kept by the stream (update mode), merged into a
    keyed table; returns the final table."""
    base = checkpoint_path(spark, name)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    q = (stream.groupBy(*keys).agg(*aggs).writeStream.outputMode("update")
         .option("checkpointLocation", f"{base}/_checkpoint")
         .foreachBatch(_merge_keyed(f"{base}/table", keys)).trigger(availableNow=True).start())
    _finish(q)
    return _latest(spark, f"{base}/table", keys)


SEQ_OUT = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("kind", T.StringType()),
                        T.StructField("position", T.LongType()), T.StructField("from_agent", T.StringType()),
                        T.StructField("to_agent", T.StringType()), T.StructField("status", T.StringType()),
                        T.StructField("progress", T.IntegerType())])
CHUNK = 512  # events of a state row
OUT_ROWS = 10_000  # rows of an output frame
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def _in_order(event: tuple):
    """Order of events: time, then id, a missing id last."""
    ts, event_id, _agent = event
    return ts, event_id is None, event_id or 0


class JobSequence(StatefulProcessor):
    """Numbers a job's events in (ts, event_id) order, whatever order they
    come in.

    Events wait in a map state.  A bucket is a span of ``bucket_ms`` of event
    time, with one timer at its end; a part is what one input frame brought
    for it, in order and cut into rows of ``CHUNK`` events.  A wide bucket
    makes few state calls for a job with few events.  When the watermark has
    passed a bucket no further event of it can come; its parts are merged, one
    chunk of each in memory, numbered and taken out, so neither a state row
    nor a frame holds a whole bucket of a hot job."""

    def __init__(self, milestones: list[tuple[int, str, int]], bucket_ms: int):
        self.milestones = {n: (s, p) for n, s, p in milestones}
        self.bucket_ms = bucket_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "count long, last_agent string, until_ms long")
        self.parts = handle.getMapState("parts", "bucket long", "chunks array<int>")
        self.held = handle.getMapState("held", "bucket long, part int, chunk int", "ts_us array<long>, event_id array<long>, agent_name array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        us = 1000 * self.bucket_ms
        for frame in rows:
            ids = [None if v is None or v != v else int(v) for v in frame["event_id"].tolist()]
            agents = [v if isinstance(v, str) else None for v in frame["agent_name"].tolist()]
            times = frame["ts_us"].tolist()  # an event without a time has no place: it is left out
            events = sorted(((int(t), i, a) for t, i, a in zip(times, ids, agents) if t is not None and t == t), key=_in_order)
            for bucket, part in itertools.groupby(events, lambda e: e[0] // us):
                end, part = (int(bucket) + 1) * self.bucket_ms, list(part)
                chunks = list((self.parts.getValue((end,)) or ([],))[0])
                for c, at in enumerate(range(0, len(part), CHUNK)):
                    self.held.updateValue((end, len(chunks), c), tuple(map(list, zip(*part[at:at + CHUNK]))))
                self.parts.updateValue((end,), (chunks + [-(-len(part) // CHUNK)],))
                if not chunks:
                    self.handle.registerTimer(end)
        return iter(())

    def _part(self, end: int, part: int, chunks: int) -> Iterator[tuple]:
        for at in ((end, part, c) for c in range(chunks)):
            held = self.held.getValue(at)
            self.held.removeKey(at)
            yield from zip(*held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        count, last, until = self.done.get() or (0, None, None)
        if until is not None and end <= until:  # would number events out of order
            raise RuntimeError(f"timer of {end} ms after that of {until} ms")
        runs = [self._part(end, i, n) for i, n in enumerate(self.parts.getValue((end,))[0])]
        out: list[tuple] = []
        for _ts, _id, agent in heapq.merge(*runs, key=_in_order):
            count += 1
            if last is not None and agent is not None and last != agent:
                out.append((key[0], "transition", count, last, agent, None, None))
            if count in self.milestones:
                out.append((key[0], "milestone", count, None, None, *self.milestones[count]))
            last = agent
            if len(out) >= OUT_ROWS:
                yield self._frame(out)
                out = []
        self.parts.removeKey((end,))
        self.done.update((count, last, end))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=SEQ_OUT.names).astype({"job_id": "Int64", "position": "Int64", "progress": "Int32"})


def sequence_state(spark: SparkSession, source: str, schema: T.StructType, milestones, watermark: str = "1 hour",
                   name: str = "sequence_state", max_files: int = 8, bucket_seconds: int | None = None) -> DataFrame:
    """STR-02: per job, count events and remember the last agent across
    micro-batches; emit speaker transitions and milestone rows.

    Events of a job are held until the watermark has passed them, then applied
    in (ts, event_id) order (``JobSequence``), so the order of files and
    batches does not matter.  They are released ``bucket_seconds`` of event
    time together, by default as many as the watermark lags: rows wait that
    long anyway, and a job has one timer for them.  ``end_of_stream`` lets a bounded
    replay pass its last events.  Null agents make no transition; a null job
    is a job like any other.  Map state and timers need the RocksDB state
    store: it is set for this query alone, and the session's own setting is
    put back once the query has started."""
    base = checkpoint_path(spark, name)
    from sparktab.functions.dates import ntz_to_instant
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    is_ntz = isinstance(schema["ts"].dataType, T.TimestampNTZType)
    events = stream.select("job_id", "event_id", "agent_name", (ntz_to_instant(F.col("ts")) if is_ntz else F.col("ts")).alias("_ts")) \
        .withWatermark("_ts", watermark).withColumn("ts_us", F.unix_micros("_ts"))
    if bucket_seconds is None:
        bucket_seconds = max(1, spark.sql(f"SELECT unix_seconds(timestamp_seconds(0) + INTERVAL '{watermark}') AS s").first()["s"])
    out = events.groupBy("job_id").transformWithStateInPandas(
        JobSequence(milestones, bucket_seconds * 1000), SEQ_OUT, "append", "EventTime")
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)  # a query takes the settings of the moment it starts
    try:
        q = (out.writeStream.outputMode("append").option("checkpointLocation", f"{base}/_checkpoint")
             .format("parquet").option("path", f"{base}/out").trigger(availableNow=True).start())
    finally:
        spark.conf.unset(PROVIDER_KEY) if before is None else spark.conf.set(PROVIDER_KEY, before)
    _finish(q)
    return spark.read.schema(SEQ_OUT).parquet(f"{base}/out")


def end_of_stream(df: DataFrame, path: str, ts: str = "ts", job: int = -1) -> None:
    """Closes a replay: one row a century after the last one, of a job of its
    own without an agent, moves the watermark past every event."""
    last = df.agg(F.max(ts).alias(ts)).select((F.col(ts) + F.expr("INTERVAL 100 YEARS")).cast(df.schema[ts].dataType).alias(ts), F.lit(job).alias("job_id"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in (ts, "job_id")]
    last.select(F.col("job_id").cast(df.schema["job_id"].dataType), ts, *rest).write.mode("overwrite").parquet(f"{path}/slice=end")


def windowed_counts(spark: SparkSession, source: str, schema: T.StructType, ts: str = "ts",
                    window: str = "1 hour", watermark: str = "1 hour", by: list[str] | None = None,
                    name: str = "windowed_counts", max_files: int = 8) -> DataFrame:
    """STR-03: event counts per event-time window (and ``by``); rows later
    than the watermark are dropped, which bounds the state."""
    base = checkpoint_path(spark, name)
    by = by or []
    from sparktab.functions.dates import instant_to_ntz, ntz_to_instant
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    is_ntz = isinstance(schema[ts].dataType, T.TimestampNTZType)
    stream = stream.withColumn("_ts", ntz_to_instant(F.col(ts)) if is_ntz else F.col(ts))
    agg = (stream.withWatermark("_ts", watermark).groupBy(F.window("_ts", window).alias("w"), *by)
           .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"))
           .select((instant_to_ntz(F.col("w.start")) if is_ntz else F.col("w.start")).alias("window_start"),
                   *by, "n", "value_sum"))
    keys = ["window_start", *by]
    q = (agg.writeStream.outputMode("update").option("checkpointLocation", f"{base}/_checkpoint")
         .foreachBatch(_merge_keyed(f"{base}/table", keys)).trigger(availableNow=True).start())
    _finish(q)
    return _latest(spark, f"{base}/table", keys)


def score_stream(spark: SparkSession, source: str, schema: T.StructType, model, name: str = "scored",
                 max_files: int = 8) -> DataFrame:
    """STR-04: apply a saved model (PipelineModel or isolation forest) to a
    file stream; scored rows are appended to parquet."""
    base = checkpoint_path(spark, name)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    scored = model.transform(stream)
    keep = [c for c in scored.columns if c not in ("features",)]
    scored = scored.select(*keep)
    q = (scored.writeStream.outputMode("append").option("checkpointLocation", f"{base}/_checkpoint")
         .format("parquet").option("path", f"{base}/out").trigger(availableNow=True).start())
    _finish(q)
    return spark.read.parquet(f"{base}/out")
