"""Times the headline queries on one machine and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the number of threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import corpus  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "file_profile", "regex_scan", "regex_scan_rule_table", "go_tokens", "static_scan", "risk_score",
    "build_prompts", "parse_model_findings", "merge_findings", "count_by_severity", "group_by_file", "scan_static_only",
    "scan_smart", "scan_deep", "scan_diff", "report_markdown", "report_json",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    files = corpus.source_files(spark, sf_dir).count()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "files": files,
    }
    if seconds.get("static_scan"):
        result["static_scan_files_per_sec"] = round(files / seconds["static_scan"], 1)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
