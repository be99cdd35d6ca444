"""Time the headline queries: one JSON line, seconds for each and in all.

Each line runs BENCH_RUNS times, and the best counts. Tables that several queries read are written
once before, as a line of their own.

BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES (names, comma-separated) override the defaults.
"""

import json
import os
import time

from starboard.registry import inputs, load_all
from starboard.registry.plans import stored_warehouse
from starboard.session import build_session, clear_work

HEADLINE = [
    "bayesian_top_n",
    "item_stats",
    "genre_top_k",
    "log_blend_top_n",
    "top_rated_having",
    "global_counts",
    "clean_movies",
    "clean_ratings",
    "clean_ratings_nodedup",
    "dynamic_partition_write",
    "partition_scan",
    "quality_report",
    "rating_pair_check",
    "orphan_check",
    "verify_ratings",
    "ratings_by_month",
    "before_after_compare",
    "verification_report",
    "join_recs_movies",
    "user_top_n",
    "page",
    "dashboard_totals",
    "serving_refresh",
    "csv_recommendations",
    "warehouse_build",
    "warehouse_recommendations",
    "als_fit",
    "als_recommend_all",
    "personalised_recommendations",
]

PREPARED = {"stored_cleaned": inputs.stored_cleaned, "stored_serving": inputs.stored_serving, "stored_pages": inputs.stored_pages, "stored_warehouse": stored_warehouse}


def timed(run, spark, sf_dir):
    started = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        settings={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    entries = load_all()
    seconds = {}
    for name, prepare in PREPARED.items():
        started = time.perf_counter()
        prepare(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - started, 3)
    for name in names:
        seconds[name] = round(min(timed(entries[name].run, spark, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    clear_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
