"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3),
BENCH_ALL=1 for every registered query. Each query is computed in full and its rows discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from panelforge.plans import QUERIES
from panelforge.session import local_session

HEADLINE = [
    "customer_order_history", "customer_order_profile", "customer_last_rows", "supplier_lags_diffs", "supplier_month_rolling",
    "supplier_rolling_shape", "user_running_stats", "user_recent_past", "user_ewm", "session_category_aggs", "sales_hierarchy_rollup",
    "sales_hierarchy_weights", "customer_part_topk", "customer_lists", "negative_parts", "user_sequences", "band_topk", "neighbor_views",
    "views_in_intervals", "target_encoding", "gaussian_encoding", "group_folds", "virtual_time_folds", "auc_quality", "gini_capture_quality",
    "f1_thresholds", "wrmsse_levels", "bar_directional", "bar_bands_macd", "text_char_classes", "reply_overlap", "stacked_ridge",
]


def main():
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": times, "sf": path.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
