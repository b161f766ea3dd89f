from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from chartmill.session import build_session  # noqa: E402
from chartmill.sizing import SMALL_INPUT_CONF  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "chartmill-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": shared,
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def scale_out(spark):
    """Treat every input as too large for the lean plans."""
    spark.conf.set(SMALL_INPUT_CONF, "-1")
    yield
    spark.conf.unset(SMALL_INPUT_CONF)


@pytest.fixture(scope="session")
def load(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def tuples(df) -> list[tuple]:
    return [tuple(row) for row in df.collect()]
