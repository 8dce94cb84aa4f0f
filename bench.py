"""Headline queries at one scale: median seconds of runs into the noop sink.

Prints one JSON line. ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_REPEATS``
set the tables, the threads and the timed runs (after ``BENCH_WARMUPS``).
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from basalt import queries as q
from basalt.result import discard

HEADLINE = [
    "tpch_q1", "tpch_q3", "tpch_q4", "tpch_q6", "tpch_q9", "tpch_q10", "tpch_q12", "tpch_q18",
    "join_then_sum", "join_group", "group_sum_count", "distinct_keys",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    repeats, warmups = int(os.environ.get("BENCH_REPEATS", "5")), int(os.environ.get("BENCH_WARMUPS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        df = q.queries()[name](spark, sf_dir)
        took = []
        for i in range(warmups + repeats):
            began = time.perf_counter()
            discard(df)
            if i >= warmups:
                took.append(time.perf_counter() - began)
        seconds[name] = round(median(took), 4)
    sys.stdout.write(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
