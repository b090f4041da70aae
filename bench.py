"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemill.queries import QUERIES
from tidemill.session import build_session, remove_scratch

HEADLINES = [
    "mart_stats_by_group",
    "mart_power_law_outliers",
    "mart_ratio_by_group",
    "window_global_rank",
    "agg_median",
    "agg_median_ranged",
    "agg_sum",
    "agg_regression",
    "agg_count_distinct",
    "agg_topk_values",
    "filter_range",
    "join_inner",
    "join_preaggregated",
    "set_intersect",
    "profile_table",
    "profile_samples",
    "candidate_keys",
    "infer_relationships",
    "profile_dataset",
    "run_checks",
    "check_relationship",
    "fanout_check",
    "result_sanity",
    "guarded_query",
    "chain_hops",
    "scan_json",
    "scan_csv",
    "land_dataset",
    "rowcount_snapshot",
    "operate_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tidemill-bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, sf_dir, "filter_scalar_subquery")  # starts the JVM's code paths; not counted
    seconds = {name: run(spark, sf_dir, name) for name in HEADLINES}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    remove_scratch(spark)
    spark.stop()


def run(spark, sf_dir: str, name: str) -> float:
    """Seconds to build the query and produce every row of it."""
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


if __name__ == "__main__":
    main()
