"""Run all charts of a spec file as one Spark job.

    python -m chartmill --spec charts.yaml --out /data/charts --format csv --parallel 8
    spark-submit --py-files chartmill.zip chartmill/__main__.py --spec charts.yaml --out /data/charts
"""

from __future__ import annotations

import argparse
import sys

from chartmill.plans.batch import chart_batch, write_batch
from chartmill.plans.spec import load_spec
from chartmill.session import build_session
from chartmill.sources.sinks import FORMATS


def main(arguments: list[str] | None = None) -> int:
    """0 when every chart was written, 1 when some failed."""
    options = argparse.ArgumentParser(prog="chartmill", description=__doc__.splitlines()[0])
    options.add_argument("--spec", required=True, help="YAML or JSON file")
    options.add_argument("--out", required=True, help="folder for the datasets, one subfolder per chart")
    options.add_argument("--data", help="table that replaces the spec's default source")
    options.add_argument("--format", default="parquet", choices=FORMATS)
    options.add_argument("--parallel", type=int, default=4, help="charts written at the same time")
    options.add_argument("--master", help="Spark master, where spark-submit does not set it")
    chosen = options.parse_args(arguments)

    spark = build_session("chartmill", chosen.master)
    with chart_batch(spark, load_spec(chosen.spec), chosen.data) as batch:
        outcomes = write_batch(batch, chosen.out, chosen.format, chosen.parallel)
    for outcome in outcomes:
        result = f"{outcome.rows} rows in {outcome.path}" if outcome.ok else outcome.error
        print(f"{outcome.name}: {result}")
    failed = sum(not outcome.ok for outcome in outcomes)
    print(f"{len(outcomes) - failed} written, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
