"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from leakloom import queries as core

HEADLINE = (
    "scan_custom_rules", "scan_source_counts", "detect_regex_batch", "detect_near_context", "detect_pair_nearest", "detect_catalog_all", "decode_base64", "decode_percent",
    "window_spans", "vicinity_islands", "dedup_findings", "cross_commit_collapse", "pii_container_density", "placeholder_filter", "redact_text", "json_records",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = core.queries()
    queries["scan_stats"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("/")[2]}))


if __name__ == "__main__":
    main()
