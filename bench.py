"""Times every registered query and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads, ``BENCH_QUERIES`` (optional,
comma-separated) a selection. Each query runs to its last row without a collect. The first
few run once before the clock starts, to load the engine; ``BENCH_WARM=all`` runs every
query twice and times the second run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.compare import session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402


def seconds(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = session()
    for name in chosen if os.environ.get("BENCH_WARM") == "all" else chosen[:5]:
        seconds(QUERIES[name], spark, folder)
    times = {name: round(seconds(QUERIES[name], spark, folder), 3) for name in chosen}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of all registered queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
