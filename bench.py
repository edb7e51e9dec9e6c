"""Time the headline queries, best of two runs each; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from snapledger.plans.queries import QUERIES

HEADLINE = [
    "content_hash",
    "signature_lookup",
    "assign_blobs",
    "take_snapshot_first",
    "take_snapshot_repeat",
    "take_snapshot",
    "take_snapshot_incremental",
    "take_snapshot_always_hash",
    "distill_result",
    "distill_days",
    "clone_result",
    "clone_into_empty",
    "purge_result",
    "file_table",
    "verify_report",
    "verify_report_rehash",
]

ON_EVENTS = {"distill_days", "clone_result", "clone_into_empty"}
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("snapledger-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="snapledger-bench-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "events")}
    seconds, rate = {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        read = tables["events" if name in ON_EVENTS else "documents"]
        rate[name] = round(read / min(times))
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": rate,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
