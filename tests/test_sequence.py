"""Numbering and lags with null group keys over several partitions."""

from pyspark.sql import functions as F

from sparktab.operators.sequence import seq_lag, seq_number


def test_null_group_over_partitions(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g"), "id").repartition(7)
    got = seq_number(d, ["g"], ["id"], "rn", num_partitions=6)
    rows = got.collect()
    for g in (None, 0, 1):
        mine = sorted((r.id, r.rn) for r in rows if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    lag = {r.id: r.id_lag1 for r in seq_lag(got, ["g"], "rn", ["id"], 1).collect()}
    null = sorted(r.id for r in rows if r.g is None)
    assert [lag[i] for i in null] == [None, *null[:-1]]
