"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "vector_topk_query", "vector_topk_by_key", "retrieve_merge_signals", "confidence_score", "ir_metrics", "filter_metrics", "eval_comparison",
    "token_f1", "coverage_judge", "extract_keywords", "keyword_report", "adapt_union", "length_percentiles", "upper_median", "variant_pivot",
    "checkpoint_anti_join", "upsert_latest", "job_latest_state", "diff_assembly", "project_lookup",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from quern.plans.registry import QUERIES

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    def calibration() -> float:
        """Seconds of a fixed sum, so that machines can be told apart."""
        began = time.perf_counter()
        sum(range(20_000_000))
        return round(time.perf_counter() - began, 3)

    times = {}
    for name in HEADLINE:
        once(name)  # compiles the plan's code
        times[name] = round(statistics.median(once(name) for _ in range(3)), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cpus": int(cpus), "calibration": calibration(), "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
