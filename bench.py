"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS]. Each query is executed in full with the no-op sink
(nothing is collected to the driver) $BENCH_REPEAT times; the median is
reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codecensus.plans import queries as Q  # noqa: E402
from codecensus.session import get_session  # noqa: E402

HEADLINE = [
    "language_distribution", "structure_totals", "category_counts", "directory_distribution", "largest_files",
    "file_metrics", "code_metrics_totals", "project_patterns", "detect_technologies", "extract_dependencies",
    "identify_tooling", "key_files", "select_for_analysis", "parse_responses", "insights_summary",
    "dependency_usage", "issue_candidates", "recent_commits", "quick_summary", "recommendations",
    "analyze_full",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", app="codecensus-bench", shuffle_partitions=cpus * 2)
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            Q.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
