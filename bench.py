"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from usagelens.session import local_session  # noqa: E402

HEADLINE = [
    "redact_documents",
    "redact_conversations",
    "request_usage_rows",
    "classify_route_cost",
    "cost_summary",
    "latency_by_model",
    "latency_report",
    "cache_stats",
    "metric_latency_histogram",
    "hit_rate_30s",
    "alert_high_latency",
    "exact_lookup",
    "semantic_lookup",
    "semantic_lookup_ivf",
    "two_layer_lookup",
    "embed_pending",
    "ttl_exact_replay",
    "rate_limit_exact",
    "routing_whatif",
    "stream_counters",
]
# Rows each query reads, for rates.
INPUT = {
    "redact_documents": "documents",
    "cost_summary": "events",
    "latency_by_model": "events",
    "semantic_lookup": "embeddings",
    "semantic_lookup_ivf": "embeddings",
    "ttl_exact_replay": "events",
    "rate_limit_exact": "events",
}
RUNS = 3


def timed(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.range(1000).count()
    seconds, rates = {}, {}
    for name in HEADLINE:
        runs = [timed(spark, folder, name) for _ in range(RUNS)]
        # The first run warms the JVM.
        seconds[name] = round(statistics.median(runs[1:]), 3)
        if name in INPUT:
            rows = spark.read.parquet(f"{folder}/{INPUT[name]}.parquet").count()
            rates[name] = round(rows / seconds[name])
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": folder.rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
