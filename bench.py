"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rowassay.operators.profile import profile
from rowassay.session import build_session
from workload.queries import QUERIES

HEADLINE = (
    "a8_profile_lineitem",
    "a8_profile",
    "a8_profile_approximate",
    "a3_numeric_stats",
    "a7_top_values",
    "a7_top_long_texts",
    "a10_duplicate_rows",
    "a11_score_breakdown",
    "a12_quality_score",
    "u1_all_findings",
    "flagship_quality_score",
    "j3_categorical_drift",
    "j4_distribution_drift",
    "j6_compare_versions",
    "r8_recommendation_run",
    "v8_batch_preview",
    "w3_version_lineage",
    "w7_sliding_usage",
    "a20_event_summary",
    "e2_admission_batch",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", "rowassay-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Untimed: start the readers and let the JVM compile the shared code paths on a small table.
    for table in ("lineitem", "documents", "events"):
        spark.read.parquet(f"{folder}/{table}.parquet").count()
    for _ in range(2):
        profile(spark.read.parquet(f"{folder}/supplier.parquet")).collect()
    spent = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
    total = round(sum(spent.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": spent, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
