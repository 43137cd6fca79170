"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run to completion into Spark's no-op sink: one warm-up, then the median of
$BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "beh_momentum", "beh_volatility", "beh_volume", "beh_structure", "beh_metrics",
    "nb_metrics", "ms_metrics", "shibor_metrics",
    "statement_join", "fund_metrics", "ttm_rolling",
    "asof_fundamentals", "industry_neutral", "panel_stack", "panel_dataset",
    "label_gaussian", "label_discrete", "purged_kfold", "rank_scores", "topk_per_rebalance", "ndcg_at_k",
    "ingest_kline", "bars_clean", "bars_resample", "null_profile",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from factorlake.catalogue import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("factorlake-bench")
        .config("spark.sql.shuffle.partitions", CPUS if CPUS.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # No call-site capture per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
