"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "task_summary_quantiles", "task_duration_skew", "processing_rate", "recommendation_summary", "issues_all",
    "task_projection", "job_performance", "cluster_totals", "ineff_stage_raw", "ineff_cluster_agg", "compat_by_sql",
    "rank_tasks_by_duration", "slowest_jobs_top", "endpoint_status", "application_listing",
    "log_jobs", "log_stages", "log_task_summary", "log_node_metrics",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    from emberscope.catalog import load
    from emberscope.runtime import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    queries, _ = load()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        # the first run pays for code generation
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    spark.stop()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(found.group(1)) if found else None, "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
