"""Wall-clock benchmark of headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import all_queries  # noqa: E402
from dayfold.session import local_session  # noqa: E402

HEADLINE = [
    "seven_day_screen",       # one sensor, runs, dense calendar, past-only mean
    "day_heart_rate",         # nested arrays to day rows
    "day_app_usage",
    "night_heart_rate",       # exploded samples, ordered differences
    "daily_contrasts",        # all twelve sensors merged
    "supplier_history",       # bulk daily sums and windows over lineitem
    "second_order_history",
    "target_encodings",
    "stratified_folds",
    "prior_grid",             # 81 settings x folds x targets in one aggregation
    "targetwise_kernels",     # temporal neighbours
    "target_history",
    "target_log_loss",
    "two_run_weights",
    "calibration_search",     # 1066 settings per target
    "hot_group_quantiles",
    "isotonic_by_fold",       # 35 isotonic fits in one plan
    "platt_by_fold",          # 35 regressions, one aggregation a step
    "baseline_stages",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    queries = all_queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].spark(spark, folder).write.mode("overwrite").format("noop").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
