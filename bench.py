"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with seconds per query.

Each query is executed in full with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["momentum_sharpe", "rolling_moments_panel", "rolling_strict", "rsi", "acf", "sign_runs",
            "describe_long", "family_stats", "corr_matrix", "ecdf", "lagged_target_block", "rolling_block",
            "ewm_macd", "null_profile", "outliers_iqr"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidemark.session import get_spark
    from tidemark.plans import QUERIES

    spark = get_spark("tidemark-bench", cpus, int(cpus) if cpus.isdigit() else 8)
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    # warm-up: JVM start, class loading and the first Parquet footer reads
    QUERIES["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
