"""Time every query on local[$BENCH_CPUS] over $BENCH_SF_DIR; print one JSON line.

Each query is run twice in full (planning, execution, all result rows produced)
and the faster run counts. ``BENCH_KEYS`` limits the run to some keys.
"""

from __future__ import annotations

import json
import os
import time

from chartmill.session import build_session
from workload import QUERIES

DEFAULT_DIR = "/root/testdata/sf0.1"
ROUNDS = 2


def run(spark, key: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", DEFAULT_DIR)
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = os.environ.get("BENCH_KEYS", "").split() or list(QUERIES)
    spark = build_session(
        "chartmill-bench", f"local[{cpus}]", **{"spark.ui.enabled": "false", "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    run(spark, "weekly_series", sf_dir)  # start-up cost of the session is not a query's
    timings = {key: round(min(run(spark, key, sf_dir) for _ in range(ROUNDS)), 3) for key in keys}
    print(
        json.dumps(
            {
                "metric": "total time of all queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
