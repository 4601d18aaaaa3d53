"""Time the headline queries and print one JSON line.

Each query's result is consumed in full by a no-op sink, so nothing is collected.  The value
of a query is the median of its warm runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from tickwright.session import local_session  # noqa: E402

HEADLINE = (
    "qa_counts", "duplicate_runs", "prev_valid_time", "audit_table", "ml_ready_table", "qc_filter",
    "qa_summary", "delimited_scan", "multi_dataset_union", "row_index", "delta_ratio",
    "percentile_bounds", "percentile_bounds_narrowed", "winsorize", "clip_counts", "minmax_scale",
    "standard_scale", "robust_scale", "numeric_profile", "text_profile", "column_profile",
    "time_features", "hourly_average", "chronological_split", "variant_normalized", "scaled_for_model", "wide_clean",
    "stream_flags", "stream_hourly_average",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    warm = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, sf_dir, name)
        times[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(warm)), 3)
    print(json.dumps({
        "metric": "sum of median warm query times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cores, "spark": spark.version,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))


if __name__ == "__main__":
    main()
