"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to the noop sink, which computes every row and column and
collects none.  A first small query starts the JVM's machinery and is not counted.
"""

from __future__ import annotations

import json
import os
import time

from strandline.plans.catalogue import QUERIES
from strandline.session import local_session

HEADLINE = (
    "continuity_index", "run_events", "gap_events", "continuity_index_weights", "domain_metrics", "active_transition_share", "markov_by_pair", "change_point_best",
    "landscape_presence", "unit_trajectory", "flag_crosstab", "order_statistics", "system_period_counts", "phase_profile", "jsd_all_pairs", "ca_inertia",
    "selection_ratio", "threshold_sensitivity", "selection_monte_carlo", "domain_status", "knn_edges", "global_moran", "gstar_z", "local_event_tests",
    "landform_match", "top_n_per_group",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("status_share")
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
