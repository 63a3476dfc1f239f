"""Skew-safe ordinal numbering and row lags within groups.

A plain ``row_number().over(Window.partitionBy(g).orderBy(o))`` puts a whole
group into one task; with one group holding a third of the rows that task
becomes the job.  ``seq_number`` range-partitions on (group, order) instead,
so a hot group is spread over many tasks, numbers rows inside each
(partition, group) piece, and adds the count of the group's rows in earlier
partitions.  Numbers and counts must come from the same range partitioning:
two evaluations of a range exchange may sample different bounds (AQE can
plan the column-pruned branches differently), so the locally numbered frame
is written once with a reliable ``checkpoint()`` to the shared checkpoint
folder and both branches read that.  Only the first group of each partition can have rows in an
earlier partition, so the offset table has at most one row per partition
and its broadcast is bounded by the partition count, not by the data.

``seq_lag`` takes the value k rows earlier by an equi-join on
(group, number), whose keys are unique, so it has no hot key either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder (reliable
    checkpoint; survives executor loss, cuts the lineage)."""
    from sparktab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _n_parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def seq_number(df: DataFrame, part: list[str], order: list, out: str = "rn",
               num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row in its ``part`` group by ``order``.

    ``order`` must make a total order inside a group (end with a unique key)."""
    n = _n_parts(df, num_partitions)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(p) for p in part] + order_cols
    ranged = (df.repartitionByRange(n, *keys)
              .withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *part).orderBy(*order_cols)
    local = stable(ranged.withColumn("_lrn", F.row_number().over(w)))
    counts = local.groupBy("_pid", *part).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # only a group that started in an earlier partition gets a non-zero offset:
    # at most one such row per partition -> bounded broadcast
    # (null keys are groups too: the joins are null-safe)
    offsets = (counts.withColumn("_off", F.sum("_cnt").over(before))
               .where(F.col("_off") > 0).select(F.col("_pid").alias("_pid2"), *[F.col(p).alias(f"_p{i}") for i, p in enumerate(part)], "_off"))
    same = F.col("_pid") == F.col("_pid2")
    for i, p in enumerate(part):
        same = same & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    joined = local.join(F.broadcast(offsets), same, "left")
    return (joined.withColumn(out, (F.col("_lrn") + F.coalesce(F.col("_off"), F.lit(0))).cast("bigint"))
            .drop("_pid", "_pid2", "_lrn", "_off", *[f"_p{i}" for i in range(len(part))]))


def seq_lag(df: DataFrame, part: list[str], rn: str, cols: list[str], k: int = 1,
            suffix: str | None = None) -> DataFrame:
    """Values of ``cols`` from the row ``k`` positions earlier in the same group
    (needs the ``rn`` column from ``seq_number``); null when there is none."""
    suffix = suffix or f"_lag{k}"
    prev = df.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(part)], (F.col(rn) + k).alias("_at"), *[F.col(c).alias(c + suffix) for c in cols])
    same = F.col(rn) == F.col("_at")
    for i, p in enumerate(part):
        same = same & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    return df.join(prev, same, "left").drop("_at", *[f"_p{i}" for i in range(len(part))])


def group_counts(df: DataFrame, part: list[str], out: str = "n") -> DataFrame:
    """Row count per group joined back (partial aggregation, no hot task)."""
    return df.join(df.groupBy(*part).agg(F.count(F.lit(1)).alias(out)), part)


def prefix_sum(df: DataFrame, order: list[str], value: str, out: str, inclusive: bool = True,
               num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` over a global order without a single-task window:
    range-partition on ``order``, sum inside each partition, then add the
    totals of all earlier partitions (a table of one row per partition,
    broadcast by construction).  ``order`` must be unique per row."""
    n = _n_parts(df, num_partitions)
    ranged = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = stable(ranged.withColumn("_loc", F.coalesce(F.sum(value).over(w), F.lit(0))))
    totals = local.groupBy("_pid").agg(F.sum(value).alias("_t"))
    offsets = totals.select("_pid", F.coalesce(
        F.sum("_t").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_loc") + F.col("_off")).drop("_pid", "_loc", "_off"))


def ordered_text(df: DataFrame, part: list[str], order: list, text: str, sep: str = ",", out: str = "text",
                 chunk: int = 256) -> DataFrame:
    """(part, n, out): the texts of a group put together by ``order``, ``n`` of them.

    Rows are numbered first (``seq_number``), then joined ``chunk`` at a time and the
    pieces of a step ``chunk`` at a time again, until one piece a group is left:
    no step brings more than ``chunk`` rows of a group together, so a hot
    group's rows are spread over many tasks; only its finished text, which is the
    result, stands in one row.  Ties of ``order`` go by the text.  Null texts
    are left out, as ``listagg`` does; a group of nulls only has ``n`` 0 and
    a null text; a null key is a group; an empty table gives no rows."""
    rows = df.select(*part, *[c for c in order if isinstance(c, str) and c not in part and c != text], F.col(text).alias(text))
    d = seq_number(rows, part, [*order, text], "_at").select(
        *part, (F.col("_at") - 1).alias("_at"), F.col(text).alias("_t"), F.col(text).isNotNull().cast("bigint").alias("_n"))
    pieces = (d.agg(F.max("_at").alias("m")).first()["m"] or 0) + 1  # of the longest group: gives the number of steps
    while True:
        d = d.groupBy(*part, F.expr(f"_at div {chunk}").alias("_at")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_at", "_t")))), lambda x: x["_t"]), sep).alias("_j"),
            F.sum("_n").alias("_n")).select(*part, "_at", F.when(F.col("_n") > 0, F.col("_j")).alias("_t"), "_n")
        pieces = -(-pieces // chunk)
        if pieces <= 1:
            return d.select(*part, F.col("_n").alias("n"), F.col("_t").alias(out))


def one_row(agg: DataFrame):
    """A one-row aggregate as a struct-valued scalar subquery: Spark computes it
    once and uses it as a value in every row (no join, nothing to broadcast)."""
    return agg.select(F.struct(*agg.columns).alias("_s")).scalar()
