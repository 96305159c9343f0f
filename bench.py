"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs twice and the better time counts, so that one-off code generation and JIT warm-up do
not hide the plan. Results go to Spark's no-op sink: every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from netwatch.session import build_session

HEADLINE = [
    "feature_vector", "multi_window_features", "flagship", "packet_context", "packet_flags", "detect_zero_day",
    "ensemble_vote", "live_gate", "explain_summary", "rolling_baseline", "sustained_rules", "create_alerts",
    "correlate_alerts", "response_decisions", "forensic_evidence", "alert_flow", "decode_binary_packets",
    "ingest_field_dump", "error_distribution", "finding_to_alert", "stream_features_1s",
]

def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, "bench", shuffle_partitions=int(cpus), **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, folder: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in names:
        seconds[name] = round(min(run(name, sf_dir) for _ in range(2)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    packets = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    result = {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
              "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}
    if "feature_vector" in seconds:
        result["feature_vector_packets_per_sec"] = round(packets / seconds["feature_vector"])
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
