"""Prints one JSON line: seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], and the scan's throughput."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sieveline.plans import registry

QUERIES = "line_split prev_line shannon_per_token hex_tokens raw_matches match_counts path_flags islands_rollup findings_documents first_seen_tokens severity_rollup ledger".split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in QUERIES:
        began = time.time()
        registry.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    size = registry.documents(spark, folder).agg(F.sum(F.octet_length("content")).alias("n")).first().n
    lines = registry.document_lines(spark, folder).count()
    scan = seconds["findings_documents"]
    out = {"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "scan_mb_per_sec": round(size / 1e6 / scan, 2), "scan_lines_per_sec": round(lines / scan)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
