"""Times every named query; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads and
``BENCH_QUERIES`` an optional comma-separated choice.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matchlens.plans import catalog  # noqa: E402
from matchlens.session import local_session  # noqa: E402


def run(spark, query, sf_dir: str) -> float:
    """Seconds to build, plan and run one query to the last row."""
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    names = chosen or list(catalog.QUERIES)
    run(spark, catalog.QUERIES["edge_best"], sf_dir)  # warm the JVM once
    seconds = {name: run(spark, catalog.QUERIES[name], sf_dir) for name in names}
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
