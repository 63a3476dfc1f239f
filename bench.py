"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", "cold_total"}.
Each query is built and fully computed into Spark's ``noop`` sink (no
collect), once to warm up and once timed; ``cold_total`` sums the first runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "flagship_daily_features": "fea_flagship_daily_features",
    "profile_orders": "prf_01_profile_orders",
    "profile_wide_quality": "prf_11_15_17_20_25_quality_flags",
    "parse_localised_dates": "cln_01_parse_localised_dates",
    "invoice_payment_features": "fea_14_payment_features",
    "sql_log_audit": "sql_02_07_query_log_audit",
    "rel_window_functions": "rel_09_window_functions",
    "agent_contributions": "tel_09_agent_contributions",
    "run_metrics": "tel_18_19_20_run_metrics",
    "version_comparison": "tel_25_version_comparison",
    "forecast_30d_frozen": "fct_05_history_and_forecast",
    "forecast_30d_model": "fct_03_score_future_with_model",
    "anomaly_flag_quantile": "mlt_08_anomaly_flag",
    "isolation_forest_fit_score": "mlt_05_isolation_forest_scores",
    "automl_regression": "mlt_01_03_automl_regression",
    "stream_windowed_counts": "str_03_windowed_counts",
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from sparktab.session import get_session, ensure_checkpoint_dir
    from sparktab.plans.registry import load_all
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="bench-ckpt-", dir="/tmp"))
    reg = load_all()
    # warm the JVM and the parquet reader once
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    times, cold = {}, {}
    for label, name in HEADLINE.items():
        # first run warms the JIT and the file listing; the second is reported
        for target in (cold, times):
            t0 = time.time()
            reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            target[label] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total_warm", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else None,
           "cold_total": round(sum(cold.values()), 3)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
