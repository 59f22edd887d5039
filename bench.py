"""Wall time of the headline queries; prints one JSON line.

Every query is planned and run in full (all result rows are produced) twice;
the better run counts. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """land_records top_patterns query_patterns ranked_patterns dedupe_events query_starts enrich_queries
workgroup_stats database_stats account_rollup per_account_overview sql_feature_counts
migration_flag_counts partition_filter_totals high_complexity_queries ddl_samples_by_type
readiness_score execution_time_stats minute_concurrency error_examples s3_bucket_stats
merge_export_summaries stream_hourly_counts""".split()


def main() -> None:
    from checks.queries import QUERIES
    from loglens.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "log_rows": rows,
            }
        )
    )


if __name__ == "__main__":
    main()
