"""Time the headline queries and print one JSON line.

Each query is run once to warm up and BENCH_RUNS times for its median; results go to a sink that
computes every row and column.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # roll-ups and joins
    "auction_facts", "daily_auction_rollup", "weekly_rollup", "overview_kpis", "participation_by_type",
    # statistics
    "corr_matrix_listwise", "corr_matrix_pairwise", "corr_pairs", "detect_anomalies", "market_stress_index",
    # rolling windows
    "rolling_mean_by_type", "rolling_mean_market", "annualized_volatility",
    # text
    "clean_document", "classify_articles", "top_ngrams", "top_ngrams_stitched", "article_table",
    "normalized_index",
    # keyed merges and quality
    "upsert_auctions", "upsert_bidders", "quality_report", "top_indirect",
]


def main() -> None:
    from tenderlens.session import build_session
    from tenderlens.workload import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "6g"))
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    results = {}
    for name in HEADLINE:
        timed(name)
        results[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
        print(f"{name}: {results[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(results.values()), 3),
        "unit": "sec", "queries": results, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
