"""Local correctness loop: run registered queries on Spark and their oracle SQL
on DuckDB over the same parquet tables and compare rows, columns and values.

usage: python tools/check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 1e15:
            return int(v)
        return float(f"{v:.9g}")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(norm(x) for x in v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: repr(r))


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    import duckdb
    from sparktab.session import get_session, ensure_checkpoint_dir
    from sparktab.plans.registry import load_all
    extra = {}
    if os.environ.get("CHECK_DRIVER_MEMORY"):
        extra["spark.driver.memory"] = os.environ["CHECK_DRIVER_MEMORY"]
    if os.environ.get("CHECK_TZ"):  # run under another session time zone
        extra["spark.sql.session.timeZone"] = os.environ["CHECK_TZ"]
    if os.environ.get("CHECK_BARE"):  # a plain session, as an outside driver would build it
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        spark = get_session("local[8]", shuffle_partitions=8, extra=extra)
    if not os.environ.get("CHECK_BARE"):
        ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="ckpt-", dir="/tmp"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    reg = load_all()
    ok = bad = 0
    for name, e in reg.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = e.build(spark, sf).toPandas()
        except Exception as ex:
            bad += 1
            print(f"FAIL {name}: spark error {type(ex).__name__}: {str(ex)[:400]}")
            continue
        ts = time.time() - t0
        if not e.sql:
            print(f"rows {name}: {len(sdf)} rows ({ts:.1f}s) [{e.check}]")
            ok += 1
            continue
        try:
            ddf = con.execute(e.sql).df()
        except Exception as ex:
            bad += 1
            print(f"FAIL {name}: duckdb error {str(ex)[:400]}")
            continue
        sc, sr = rows_of(sdf)
        dc, dr = rows_of(ddf)
        kinds = {c: (sdf[c].dtype.kind, ddf[c].dtype.kind) for c in sc if c in ddf.columns
                 and sdf[c].dtype.kind != ddf[c].dtype.kind}
        if sc != dc:
            bad += 1
            print(f"FAIL {name}: columns differ spark-only={sorted(set(sc)-set(dc))} duck-only={sorted(set(dc)-set(sc))}")
        elif len(sr) != len(dr):
            bad += 1
            print(f"FAIL {name}: rows spark={len(sr)} duck={len(dr)}")
        elif sr != dr:
            bad += 1
            diffs = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            print(f"FAIL {name}: values differ ({len(sr)} rows) cols={sc}")
            for a, b in diffs:
                print("   spark:", a)
                print("   duck :", b)
        else:
            ok += 1
            print(f"ok   {name}: {len(sr)} rows ({ts:.1f}s)" + (f" dtype-kinds {kinds}" if kinds else ""))
    print(f"== {ok} ok, {bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()
