"""Headline queries at `$BENCH_SF_DIR` on `local[$BENCH_CPUS]`; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from promptledger.session import build_session  # noqa: E402
from verification import load_all  # noqa: E402
from verification.registry import QUERIES  # noqa: E402

HEADLINE = (
    "ag1_kpis", "ag8_bucket_latency", "ag10_model_usage", "ag11_pii_distribution", "flt3_search", "tk1_audit_page",
    "fn1_token_count", "fn3_key_hash", "pii11_detector_chain", "pii18_presence", "inj4_builtin_rules",
    "inj9_threshold", "jn1_authentication", "jn6_first_success", "w1_admission", "w1_busy_key", "w9_demand",
    "w1_saturated_key", "pl1_decision", "pl6_end_to_end", "pl7_replay",
)
#: Each query runs once to warm up, then so many times; the median counts.
RUNS = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
