"""Headline queries, timed: one warm-up and three runs each, the median. Prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from tessera.queries import QUERIES  # noqa: E402

HEADLINE = (
    "popular",
    "filter_time",
    "join_inner",
    "join_left_nonid",
    "join_three_way",
    "group_multi",
    "having_expr_agg",
    "order_by_agg",
    "topk",
    "distinct_rows",
    "pattern_join",
    "pattern_optall",
    "store_fold",
    "subquery_two_level",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        own = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            own.append(time.perf_counter() - start)
        times[name] = round(statistics.median(own[1:]), 3)
    size = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "median of headline queries, summed", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(size[1]) if size else folder}))
    spark.stop()


if __name__ == "__main__":
    main()
