"""Time the headline queries; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradewright.catalog import QUERIES  # noqa: E402
from gradewright.session import build_session  # noqa: E402

HEADLINE = (
    "r06_r07_scored_14_columns",
    "r06_r07_scored_22_columns",
    "g01_rule_guard",
    "g02_calibrated_guard",
    "c01_keyword_structure",
    "r01_r03_r04_r05_score_rows",
    "j06_bonus_by_table",
    "f06_funnel_counts",
    "x09_denoise",
    "x10_duplicate_clause",
    "x11_repeated_block",
    "x14_json_structure",
    "j01_merge_metadata",
    "m04_training_sets",
    "a01_reason_counts",
    "a05_summary_by_group",
    "a08_tier_distribution",
    "a11_cooccurrence",
    "a13_token_percentiles",
    "e02_overall_metrics",
    "e04_w07_stage_summary",
    "w06_efficiency",
    "e09_curated_splits",
    "t01_k07_incremental_run",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", "bench", cpus)
    for name in ("lineitem", "documents"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
