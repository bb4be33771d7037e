"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_QUERIES (comma separated name prefixes) narrows the list.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from loglake.plans import all_queries  # noqa: E402
from loglake.session import build_session  # noqa: E402

HEADLINE = [
    "a1_error_rate_per_minute",
    "a2_latency_percentiles",
    "a3_log_volume_by_type",
    "a5_error_heatmap",
    "a6_latency_p99_trend",
    "a8_top_errors",
    "a13_terms_agg_tag",
    "a19_exact_percentile",
    "a21_duplicate_rate",
    "a24_histogram_quantile",
    "a28_metric_rollup",
    "c1_infer_tag_schema",
    "f4_last",
    "f10_search_documents",
    "f10_search_logs",
    "f10_scan_documents",
    "f10_scan_logs",
    "f11_search_ranked",
    "f11_scan_ranked",
    "g2_route_queries",
    "j1_tenant_settings",
    "j2_drop_seen",
    "j4_trace_spans",
    "j8_tpch_revenue",
    "k2_upsert_hot",
    "l1_evaluate_rules",
    "l9_backtest_rules",
    "m2_read_view",
    "m7_merge_sketches",
    "m7_merge_counts",
    "r2_replay",
    "s6_read_archive",
    "t3_dedup_stream",
    "t6_alert_stream",
    "t10_over_quota",
    "u1_cross_tier",
    "v1_validate_entries",
    "w1_keep_first",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = tuple(filter(None, os.environ.get("BENCH_QUERIES", "").split(",")))
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.checkpoint.dir": shared},
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = all_queries()[0]
    names = [n for n in (run if wanted else HEADLINE) if not wanted or n.startswith(wanted)]
    # Warm the JVM and the file cache once; every query is then timed on its own; the median of RUNS counts.
    run["a1_error_rate_per_minute"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, best = {}, {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name], best[name] = round(sorted(runs)[len(runs) // 2], 4), round(min(runs), 4)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "best": best,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)  # what the storage queries wrote


if __name__ == "__main__":
    main()
