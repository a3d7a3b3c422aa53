"""Times the headline queries: one JSON line with seconds by query, best of three runs.

``rows_per_sec`` is at the given scale, where starting jobs is most of the time;
``large`` has the three workloads over the events ``BENCH_TIMES`` times over, with users
of their own in each copy, so that throughput is measured (0 leaves it out).
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidefold.queries import QUERIES
from tidefold.session import get_spark

HEADLINE = (
    "map_project", "filter_predicate", "flat_map_duplicate", "dedup_by_user", "delta_spike", "stateful_running_sum", "stateful_running_stats", "stateful_bucketed",
    "stateful_clamped", "stateful_ewma", "track_prev_keyed", "track_prev_global", "journal_sliding_window", "slot_latest", "latency_stats_exact",
    "sensor_alerts", "health_alerts", "book_deltas", "book_levels", "book_imbalance",
)
LARGE = ("sensor_alerts", "health_alerts", "book_levels", "book_imbalance")


def seconds(spark: SparkSession, name: str, sf_dir: str, runs: int) -> float:
    """The best time of a query, its result thrown away."""
    found = []
    for _ in range(runs):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        found.append(time.perf_counter() - start)
    return round(min(found), 4)


def large(spark: SparkSession, sf_dir: str, times: int) -> dict[str, float | int]:
    """Seconds and rows a second over many copies of the events."""
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        # copies keep the order of events and do not share users
        span = events.agg(F.max("event_id") + 1, (F.max("user_id") + 16) - F.max("user_id") % 16).first()
        copies = events.crossJoin(spark.range(times).withColumnRenamed("id", "copy"))
        copies = copies.withColumns({"event_id": F.col("event_id") + F.col("copy") * span[0], "user_id": F.col("user_id") + F.col("copy") * span[1]}).drop("copy")
        copies.write.parquet(f"{folder}/events.parquet")
        rows = spark.read.parquet(f"{folder}/events.parquet").count()
        found = {name: seconds(spark, name, folder, 1) for name in LARGE}
        return {"rows": rows, **found, **{f"{k}_rows_per_sec": round(rows / v) for k, v in found.items()}}
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", master=f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark.sparkContext.setLogLevel("ERROR")
    found = {name: seconds(spark, name, sf_dir, 3) for name in HEADLINE}
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    out = {
        "metric": "headline_total", "value": round(sum(found.values()), 4), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")),
        "rows_per_sec": {k: round(rows / v) for k, v in found.items()},
    }
    times = int(os.environ.get("BENCH_TIMES", "100"))
    if times:
        out["large"] = large(spark, sf_dir, times)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
