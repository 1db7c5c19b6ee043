"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 5). Each query is planned and run from scratch every time; a
query's time is the median after two warm-up rounds of all queries. ``value`` is their sum.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from daybook.registry.queries import queries  # noqa: E402
from daybook.session import local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

HEADLINES = [
    "summary_latest", "summary_month_end",
    "q1_today", "q2_mtd", "q3_prev_same_day", "q4_prev_month",
    "leaderboard_latest", "leaderboard", "leaderboard_suppliers",
    "top_destinations_latest", "top_destinations",
    "daily_trend_latest", "daily_trend", "monthly_trend_latest", "monthly_trend",
    "charts_json", "orders_parsed", "load_check", "primary_key_check",
    "product_insert_if_absent", "daily_rollup", "csv_load_orders", "csv_load_products",
]


def timed(query, spark) -> float:
    start = time.perf_counter()
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, "daybook-bench")
    named = queries()
    times = {}
    for name in HEADLINES * 2:
        timed(named[name], spark)
    for name in HEADLINES:
        times[name] = round(statistics.median(timed(named[name], spark) for _ in range(RUNS)), 3)
    spark.stop()
    scale = re.search(r"sf([\d.]+)", FOLDER)
    print(json.dumps({
        "metric": "warm median seconds, summed over queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else FOLDER,
        "cpus": CPUS,
        "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
