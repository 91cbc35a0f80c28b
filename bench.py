"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from docketspark.plans.registry import QUERIES
from docketspark.plans.serving import feature_table

HEADLINE = (
    "lookup_baseline_precision_at_k", "rolling_rate_90_365", "prior_count", "prior_distinct_agencies", "matured_history", "matured_rate", "crossfit_rate",
    "asof_backward", "latest_per_agency", "roc_auc", "average_precision", "reliability_deciles", "equity_audit", "missing_by_recency", "within_group_quartiles", "refresh_tables",
    "text_model_score",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: QUERIES[n] for n in HEADLINE} | {"feature_table": feature_table}
    queries["lookup_baseline_precision_at_k"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and warms up
    took = {}
    for name, q in queries.items():
        began = time.perf_counter()
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
