"""Time the headline queries on one machine; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from pitpanel.catalog import catalog
from pitpanel.session import local_session

HEADLINE = [
    "point_in_time_scores", "gate_last_before_day", "business_day_totals", "latest_per_entity_asof", "latest_order_asof",
    "last_row_per_key", "vintage_diff", "vintage_revision_stats", "seasonal_naive_7d", "two_tier_lookup",
    "panel_join_left_chain", "text_class_shares", "zscore_covered_only", "grid_weights", "degree_day_daily",
    "period_end_utc", "score_overall_and_groups", "scores_with_effective_n", "autocorr_effective_n", "diebold_mariano",
    "fold_assignment", "running_gram", "walk_forward_simple_ols", "walk_forward_full", "demean_two_way_balanced",
    "two_way_fe_beta", "wild_bootstrap_enumerated", "placebo_runs", "power_curve", "stream_gate",
]


def main(names: list[str]) -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session("bench", cpus=cpus)
    queries, seconds = catalog(), {}
    spark.read.parquet(f"{sf}/nation.parquet").count()  # start the executors before the clock
    for name in names or HEADLINE:
        start = time.perf_counter()
        queries[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main(sys.argv[1:])
