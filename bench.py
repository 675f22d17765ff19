"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input and
the cores. One untimed query warms the JVM up; every other query runs three times and whole, its
result going to a sink that discards it. The median run counts; "build" is its share of planning
on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "passthrough", "detect_email", "detect_url", "detect_ipv4", "detect_credit_card",
    "detect_ssn", "detect_phone", "detections", "masked_texts", "per_text_report",
    "detections_by_type", "detections_by_source", "reject_summary", "protected_mappings",
    "sealed_round_trip", "rehydrated_replies", "leak_check", "parsed_replies",
    "analyzed_requests", "analyzed_stored", "throttled_events",
)


RUNS = 3


def main() -> None:
    from textguard.plans.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textguard-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.textguard.input.partitions", cpus)
        # call-site capture costs several JVM calls for every column function
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> tuple[float, float]:
        """Seconds to build the query, and to run it."""
        started = time.perf_counter()
        query = QUERIES[name](spark, sf_dir)
        built = time.perf_counter()
        query.write.format("noop").mode("overwrite").save()
        return built - started, time.perf_counter() - built

    run("masked_texts")
    runs = {name: sorted((run(name) for _ in range(RUNS)), key=sum)[RUNS // 2] for name in HEADLINE}
    times = {name: round(sum(pair), 3) for name, pair in runs.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "build": {name: round(pair[0], 3) for name, pair in runs.items()},
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
