"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shiftwright.plans.registered import QUERIES  # noqa: E402

HEADLINE = [
    "scan_matches", "scan_summary", "file_tasks", "detect_framework",
    "rewrite_if", "rewrite_else", "rewrite_switch", "rewrite_nested", "rewrite_tags", "line_diff",
    "verify_text", "secrets_scan", "stage_gate", "confidence", "retry_routing",
    "report_summary", "retrieve_words", "retrieve_vectors", "attempts_stream",
]
# Table whose rows are the files of a query.
FILES = {
    "scan_matches": "pages", "scan_summary": "pages", "rewrite_if": "orders", "rewrite_else": "orders",
    "rewrite_switch": "orders", "rewrite_nested": "part", "rewrite_tags": "pages",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scan_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in {FILES[n] for n in names if n in FILES}}
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "files_per_second": {n: round(rows[FILES[n]] / seconds[n]) for n in names if n in FILES},
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
