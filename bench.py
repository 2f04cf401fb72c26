"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pyspark.sql import SparkSession

from slipmill.plans import records  # noqa: F401  its queries join the others
from slipmill.plans.queries import QUERIES

HEADLINE = ("supplier_spend", "v2_fields", "quality_fields", "receipts", "value_model", "voted_attempts", "crop_model", "calibration", "streamed_counters", "written_vouchers", "applied_models", "validated_fields", "robust_path")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["v2_fields"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()  # so that no query carries the start
    took, start, budget = {}, time.time(), float(os.environ.get("BENCH_BUDGET_S", "900"))
    for name in HEADLINE:
        if time.time() - start > budget:  # the slow ones stand last; what isn't begun is told
            break
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "not_begun": [q for q in HEADLINE if q not in took]}))


if __name__ == "__main__":
    main()
