"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query runs to the end into
a sink that keeps nothing; the time includes planning and all jobs of the query. One
unmeasured query first starts the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from plumbline.catalog import QUERIES

HEADLINE = (
    "mask_text_documents", "detect_pii", "pii_by_value", "infer_schema", "numeric_stats", "high_corr_pairs",
    "profile", "outer_join_key", "outer_join_3way", "asof_backward", "asof_nearest", "asof_by_user",
    "asof_shared_times", "asof_chain_folders", "encode_labels", "prepare", "scale_z", "class_weights",
    "ts_lags", "ts_rolling_by_user", "ts_features", "split_random", "split_time", "run_audits",
    "reg_metrics", "diagnose", "best_run", "usage_rollup", "request_reuse", "forecast_diagnosis",
    "fit_regression_linear_regression", "fit_decision_tree", "fit_knn", "smote_counts", "folder_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["fit_knn"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    result = {"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds}
    print(json.dumps({**result, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
