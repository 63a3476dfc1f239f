"""Physical-plan audit of every registered query: join strategies, single-
partition exchanges, Python evaluation nodes.  usage: python tools/plan_audit.py [sf_dir] [name...]"""

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = ["SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
        "Exchange SinglePartition", "Exchange hashpartitioning", "Exchange rangepartitioning", "Window",
        "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "Subquery"]


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    from sparktab.session import get_session, ensure_checkpoint_dir
    from sparktab.plans.registry import load_all
    spark = get_session("local[8]", shuffle_partitions=8)
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="audit-", dir="/tmp"))
    for name, e in load_all().items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            df = e.build(spark, sf)
            plan = df._jdf.queryExecution().executedPlan().toString()
        except Exception as ex:  # noqa: BLE001
            print(f"{name}: ERROR {str(ex)[:120]}")
            continue
        counts = {k: len(re.findall(re.escape(k), plan)) for k in KEYS}
        flags = {k: v for k, v in counts.items() if v}
        print(f"{name}: {flags}")
    spark.stop()


if __name__ == "__main__":
    main()
