"""Run queries on Spark and their SQL on DuckDB and compare all rows and types.

    python tools/compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chartmill.session import build_session  # noqa: E402
from workload import ORACLE_SQL, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: [(value is not None, str(value)) for value in row])


def differences(spark, con, sf_dir: str, key: str) -> list[str]:
    """What differs between a query and its SQL; empty when nothing does."""
    df = QUERIES[key](spark, sf_dir)
    ours = _rows(df.columns, [tuple(row) for row in df.collect()])
    described = con.execute(f"DESCRIBE {ORACLE_SQL[key]}").fetchall()
    names = [row[0] for row in described]
    theirs = _rows(names, con.execute(ORACLE_SQL[key]).fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    expected = {row[0]: str(row[1]) for row in described}
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind, kind) != expected[name]:
            problems.append(f"type of {name}: {kind} != {expected[name]}")
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if unequal:
        problems.append(f"{len(unequal)} rows differ, first {unequal[0][0]} != {unequal[0][1]}")
    if not ours:
        problems.append("no rows")
    return problems


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for key in args[1:] or QUERIES:
        start = time.time()
        try:
            problems = differences(spark, con, sf_dir, key)
        except Exception as error:  # shown, then the next query
            problems = [f"{type(error).__name__}: {str(error)[:400]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {key} {time.time() - start:.2f}s", *problems, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
