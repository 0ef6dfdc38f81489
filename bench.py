"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 3: one cold run and the median of the others). A query's rows are all
computed and thrown away by the no-op sink.
"""

import json
import os
import statistics
import sys
import time

from reviewmill.plans.catalog import QUERIES
from reviewmill.session import local_session

HEADLINE = ["red_flag_categories", "domain_language_dataset", "domain_language_row", "vector_topk",
            "tfidf_weights", "linear_score", "cluster_table"]


def seconds(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    cold, warm = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        times = [seconds(spark, sf_dir, name) for _ in range(runs)]
        cold[name] = round(times[0], 3)
        warm[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus}))


if __name__ == "__main__":
    main()
