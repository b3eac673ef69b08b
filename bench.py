"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from turnout.queries import QUERIES

HEADLINE = (
    "engagement_counters", "contact_metrics", "top_accounts", "outlier_fence", "engagement_anomalies", "attendee_funnel",
    "movement_windows", "movement_breakdown", "stage_history", "enrichment_cascade", "fill_rates", "company_rows",
    "duplicate_pairs", "crm_matches", "ab_arms", "recipients", "contact_snapshot", "snapped_moments", "clip_ends",
    "merged_turns", "quote_locations", "strict_grounding", "call_summary",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["call_summary"].run(spark, folder).write.format("noop").mode("overwrite").save()  # start workers and compiler once
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


main()
