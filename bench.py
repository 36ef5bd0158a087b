"""Headline queries on one machine; prints one JSON line.

Each query is run once to warm up and then timed as the median of three runs (one run where
the first took over four seconds) that materialise every row and column (noop sink). Derived inputs (bars, memberships,
predictions) are staged by the first run of a query that needs them; `staging_sec` reports
what those first runs took beyond the timed ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "theme_strength", "velocity_confirmed", "activity", "heat", "selection", "session_returns", "theme_display", "stock_setups",
    "regime_daily", "holding_periods", "daily_change", "day_result", "walk_forward",
    "score_outcomes", "usage_changes", "classify_event", "dedupe_articles", "rank_sentences", "page_text",
]
RUNS = 3


def main() -> None:
    from tidemark.plans import catalog
    from tidemark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    catalog.load()
    spark = local_session(cpus, partitions=int(cpus))
    per, first = {}, {}

    def once(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:
        first[name] = once(name)
        runs = RUNS if first[name] < 4 else 1
        per[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name}: {per[name]} (first {first[name]:.2f})", file=sys.stderr, flush=True)
    out = {
        "metric": "headline_total",
        "value": round(sum(per.values()), 3),
        "unit": "sec",
        "queries": per,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": int(cpus),
        "staging_sec": round(sum(max(0.0, first[n] - per[n]) for n in names), 3),
        "settings": {"shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "runs": RUNS, "spark": spark.version},
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
