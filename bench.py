"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR   folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 3)
BENCH_QUERIES  comma-separated names, or ``all``
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidewell.session import local_session
from tidewell.workbook import REGISTRY, Tables

HEADLINE = [
    "agg_sum", "agg_count_distinct", "agg_multi", "ts_day", "ts_week", "ranking_sum",
    "ratio_ranking", "comparison", "filter_spec", "widget_agg2", "widget_top", "column_profile",
    "column_profile_wide", "duplicate_check", "freshness", "numeric_stats", "outliers",
    "quintile_trend", "classify_columns", "classify_values", "run_stats", "flow_summary",
    "load_durations", "user_overview", "latest_n_per_key", "usage_rollup", "lineage_edges",
    "query_audit", "table_search", "model_versions", "csv_types", "infer_schema",
    "merge_upsert", "merge_duplicates", "auto_heatmap", "stream_daily",
    "incremental_sync", "insights", "model_search", "model_versions_hot", "load_durations_all",
    "report_one_scan",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    # the noop sink runs the whole plan without bringing rows to the driver
    REGISTRY[name].run(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = local_session(cpus, "tidewell-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, folder)
        seconds[name] = round(statistics.median(timed(spark, name, folder)
                                                for _ in range(runs)), 4)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
        "cpus": cpus, "runs": runs, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
