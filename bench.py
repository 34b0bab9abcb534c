"""Headline queries on local Spark; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the cores, BENCH_QUERIES
(comma-separated) replaces the list of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tracegraph.plans import QUERIES
from tracegraph.session import local_session

HEADLINE = [
    "p01_definition_of",
    "g01_callers_of",
    "g01_callers_of_depth5",
    "g01_callers_of_all_classes",
    "g02_callees_of_depth3",
    "g03_path_hops",
    "g05_impact",
    "g06_test_coverage",
    "g07_scope_files",
    "g15_receiver_resolution",
    "g16_argument_sources",
    "g19_causal_chain",
    "g20_multi_anchor",
    "f14_match_text",
    "s12_recency_top3",
    "p09_changed_symbols",
    "a13_hit_rates",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("tracegraph-bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    QUERIES["p03_matchable_kinds"](spark, directory).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": directory.rstrip("/").rsplit("sf", 1)[-1], "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
