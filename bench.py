"""Headline queries, each run to completion once warm; prints one JSON line.

BENCH_SF_DIR: folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS: local threads (default 8)
BENCH_ONLY: comma-separated name prefixes, for work on single queries
"""

from __future__ import annotations

import json
import os
import sys
import time

from pulsegrid import session
from pulsegrid.catalog import load_all

HEADLINE = [
    # readings to hub tables
    "d01_minute_mean", "d02_duplicate_intervals", "c03_interval_flag", "d03_ten_minute_hub", "d04_daily",
    # grid, runs, segments, masks
    "d03_slot_grid", "e02_missing_runs", "d30_segment_summary", "d29_threshold_scan", "e25_random_mask", "e26_block_mask",
    # fills and ordered features
    "e01_reading_gaps", "e08_straight_line", "e09_lags_leads", "e14_trailing_cycle", "e22_decayed_average", "e23_hourly_state",
    # cohort statistics
    "d05_presence", "d07_missingness", "d13_density", "d16_day0_vs_usual", "d18_block_stages", "d27_correlations",
    # episodes and windows
    "a08_date_sheets", "c08_day_in_episode", "c09_next_onset", "c10_event_window", "c11_history_window",
    # scores and resampling
    "d35_error_scores", "d45_all_and_groups", "d47_slices", "d48_bootstrap_interval", "d49_permutation_test",
    # closed-form and tree models
    "h04_rhythm_forecast", "h04_rhythm_filler", "h10_nearest_neighbours", "h01_tree_filler", "h05_day_window_classifier",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    spark = session.build(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()  # start the JVM's engines
    seconds = {}
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only):
            continue
        t = time.time()
        reg[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
