"""Summarise the plans that queries really ran with.

    python tools/plans.py [sf_dir] [key ...]
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chartmill.session import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402

COUNTED = {
    "scans": r"FileScan",
    "shuffles": r"\+- Exchange ",
    "broadcasts": r"BroadcastExchange ",
    "reused": r"ReusedExchange",
    "windows": r"\+- Window ",
    "sort aggregates": r"SortAggregate",
    "nested loops": r"NestedLoop|CartesianProduct",
    "python": r"Python|Pandas|Arrow",
}


def final_plan(df) -> str:
    """The plan that ran, without the initial plans AQE prints next to it."""
    df.collect()
    kept, cut = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        indent = len(line) - len(line.lstrip(" :"))
        if cut is not None and indent >= cut:
            continue
        cut = indent if "== Initial Plan ==" in line else None
        if cut is None:
            kept.append(line)
    return "\n".join(kept)


def summary(plan: str) -> dict[str, int]:
    return {name: count for name, pattern in COUNTED.items() if (count := len(re.findall(pattern, plan)))}


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    for key in args[1:] or QUERIES:
        counts = summary(final_plan(QUERIES[key](spark, sf_dir)))
        print(key, ", ".join(f"{name} {count}" for name, count in counts.items()), sep=": ", flush=True)


if __name__ == "__main__":
    main()
