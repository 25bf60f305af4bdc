"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is forced end to end with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glossa.plans import REGISTRY  # noqa: E402
from glossa.session import get_session  # noqa: E402

HEADLINE = [
    "f2_bleu", "f3_chrf", "f4_rouge_n", "f5_rouge_l", "f6_rouge_lsum", "f11_test_report",
    "e4_weighted_prf_lineitem", "e2_e4_label_report", "d2_merge_predictions", "h5_bucket_mean",
    "b8_prepare", "e9_greedy_match_mean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=2 * cpus, app_name="glossa-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up: JVM code paths and the Python worker pool (not timed)
    REGISTRY["e1_confusion"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    REGISTRY["f2_bleu"].fn(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "cpus": cpus,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
