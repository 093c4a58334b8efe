"""Time the headline queries; prints one JSON line.

Each query is computed in full (written to the `noop` sink). A small warm-up run
keeps JVM start and class loading out of the figures.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession  # noqa: E402

from checks.registry import all_queries  # noqa: E402

HEADLINE = (
    "src14_series_result_table",
    "win01_07_inventory_window_metrics",
    "agg01_per01_08_wix02_inventory_period_summary",
    "agg01_per09_17_wix02_campaign_period_summary",
    "agg02_08_ent01_31_inventory_entity_summary",
    "agg02_08_ent32_55_campaign_entity_summary",
    "agg09_joi06_dim01_06_inventory_dimension_summary",
    "agg10_inventory_headline",
    "rsk01_10_inventory_risks",
    "rsk11_17_campaign_risks",
    "top02_top_risks",
    "top03_inventory_movers",
    "joi02_period_deltas",
    "coe01_coe03_src03_src04_typed_rows",
    "coe02_number_spellings",
    "ded02_ded03_last_record",
    "im01_03_imx01_imx03_inventory_imputation",
    "qua03_04_inventory_violation_counts",
    "qua06_qry05_csv_quality_issues",
    "src01_src02_csv_scan",
    "src07_mojibake_repair",
    "src09_turkish_score",
    "grd03_04_verified_claims",
    "grd06_collected_evidence",
    "agg14_call_log_rollup",
    "src11_newest_datasets",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    only = os.environ.get("BENCH_QUERIES")
    names = [n for n in HEADLINE if not only or n.startswith(tuple(only.split(",")))]
    queries[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
