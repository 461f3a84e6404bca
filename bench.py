"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlark.catalog import QUERIES  # noqa: E402
from ledgerlark.session import local_session  # noqa: E402

HEADLINE = [
    "payment_features",
    "payment_features_mixed_kinds",
    "settled_history_features",
    "numeric_payments",
    "graph_degree",
    "asof_last_k_neighbors",
    "amount_surprise_bits",
    "ranking_metrics",
    "policy_frontier",
    "recall_at_budget",
    "empirical_tail_score",
    "decide_adaptive_budget",
    "released_feedback",
    "chronological_split",
    "column_statistics",
    "score_tree_ensemble",
    "temporal_components",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    QUERIES["payment_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
