"""Times the one-pass reports against their plain form (tests/naive.py), over the
sample lines as they are, over a stored fact and over a stored rollup.

Environment as for bench.py; BENCH_COPIES (default 1) repeats the lines.
"""

from __future__ import annotations

import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pyspark.sql import functions as F  # noqa: E402

import naive  # noqa: E402
from bench import CPUS, FOLDER, RUNS  # noqa: E402
from daybook import Dashboard  # noqa: E402
from daybook.operators.anchor import as_of  # noqa: E402
from daybook.plans import book  # noqa: E402
from daybook.session import local_session, scratch  # noqa: E402
from daybook.sources import sample  # noqa: E402
from daybook.sources.stored import read_sales  # noqa: E402

COPIES = int(os.environ.get("BENCH_COPIES", "1"))


def spread(query) -> str:
    """Median, least and most of the runs, in seconds."""
    def run() -> float:
        start = time.perf_counter()
        query().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start
    run()
    times = [run() for _ in range(RUNS)]
    return f"{statistics.median(times):.2f} ({min(times):.2f}-{max(times):.2f})"


def main() -> None:
    spark = local_session(CPUS, "daybook-forms")
    lines = sample.lines(spark, FOLDER)
    if COPIES > 1:
        copies = F.explode(F.sequence(F.lit(1), F.lit(COPIES)))
        lines = lines.withColumn("copy", copies).drop("copy")
    fact, rollups = scratch(spark, "fact"), scratch(spark, "rollups")
    book.write_fact(lines, fact)
    book.write_rollups(read_sales(spark, fact), rollups)
    users = sample.suppliers(spark, FOLDER)
    boards = {"fact": Dashboard.stored(spark, fact, users), "rollup": Dashboard.rolled_up(spark, rollups, users)}
    if COPIES == 1:
        boards = {"lines": Dashboard(sample.lines(spark, FOLDER), users), **boards}
    for day in (None, "1998-03-31"):
        for name, board in boards.items():
            sales = board.sales
            forms = {"summary": lambda: board.summary(day), "leaderboard": lambda: board.leaderboard(day)}
            if name != "rollup":
                forms["plain summary"] = lambda: naive.summary(sales, as_of(sales, day))
                forms["plain leaderboard"] = lambda: naive.leaderboard(sales, users, as_of(sales, day))
            for form, query in forms.items():
                print(f"{day or 'latest':10}  {name:6}  {form:18} {spread(query)}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
