"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

    python bench.py            headline queries
    python bench.py all        every registered query, one run each
    python bench.py name ...   the named queries

Each query runs in full into a no-op sink: one warm-up and the best of two timed runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "endpoint_catalog", "json_leaf_table", "order_lineage", "value_lineage", "lineage_edges_v2",
    "lineage_one_session", "endpoint_catalog_v2", "openapi_documents", "link_catalog", "forms",
    "feed_changes", "text_digests",
)


def _scale(sf_dir: str) -> float | str:
    name = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main(argv: list[str]) -> None:
    from siftlane.plans import QUERIES
    from siftlane.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    every = argv[1:] == ["all"]
    names = list(QUERIES) if every else argv[1:] or list(HEADLINE)
    spark = local_session(cpus, partitions=cpus, memory="12g", app="bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    run("endpoint_catalog")  # starts the JVM's code paths and the Python workers
    timings = {}
    for name in names:
        first = run(name)
        timings[name] = round(first if every else min(run(name), run(name)), 3)
        if every:
            print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": _scale(sf_dir), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
