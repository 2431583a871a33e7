"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from kohorta.bindings import QUERIES

HEADLINE = ["patient_features", "screen_univariate", "auc", "segment_records", "measurement_table", "medication_classes",
            "sweep_selection", "roc_spread", "lag_trend", "pre_event_records", "header_attributes", "scan_ragged_quoted",
            "screen_interactions", "impute_pmm"]


def run(spark, name, location):
    start = time.perf_counter()
    QUERIES[name](spark, location).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main():
    location = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("kohorta-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    cold = {name: run(spark, name, location) for name in names}
    warm = {name: run(spark, name, location) for name in names}
    print(json.dumps({"metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "sf": location.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
