"""Runs the headline queries and prints one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from strandlog import catalog
from strandlog.session import session, shared_dir

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "scan_raw", "scan_bundle", "point_read", "verify_files", "query_simple_nested", "query_jmes_filter", "query_stats", "stats_operations", "stats_dids", "inspect_domains", "inspect_hourly", "resolve_latest", "did_state",
    "did_document", "canonical_chain", "fork_winner", "content_hash", "chain_hash", "verify_bundle", "did_index_build", "compare_index", "export_stats", "export_reverse",
]


def main() -> None:
    spark = session("bench", **{"spark.master": f"local[{CPUS}]", "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # the log is built once and stored, as bundle files for what scans them and as a table for the rest
    path = f"{shared_dir(spark)}/bench-log"
    catalog.ops_of(spark, SF_DIR).write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    n = table.count()
    derived, catalog.ops_of = catalog.ops_of, lambda spark, sf_dir: table
    catalog.stored(spark, SF_DIR)
    took = {}
    try:
        for name in HEADLINE:
            best = None
            for _ in range(2):
                t = time.perf_counter()
                catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
                best = min(best or 1e9, time.perf_counter() - t)
            took[name] = round(best, 3)
    finally:
        catalog.ops_of = derived
    extra = {"operations": n, "ops_per_s_scan_and_path": round(n / took["query_simple_nested"]), "ops_per_s_group_by": round(n / took["stats_operations"]), "ops_per_s_latest_of_all": round(n / took["resolve_latest"]), "bundles_per_s_verified": round(n / catalog.SIZE / took["verify_files"], 1), "ops_per_s_scan_of_files": round(n / took["scan_raw"])}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
