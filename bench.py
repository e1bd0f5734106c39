"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1). BENCH_CPUS: threads (default 8)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from repovitals.plans import catalog  # noqa: E402

HEADLINE = ["churn_weighted", "cochange_pairs", "bus_factor", "hotspots_risk", "category_score", "readiness", "weekly_compaction", "backpressure_trend", "bisect_drift", "clone_impact", "package_health", "baseline_compare", "changed_scope_findings", "scc_components", "propagation_cost", "glossary_terms", "term_conflicts", "finding_signals"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
