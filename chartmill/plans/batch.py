"""Many charts from one spec: shared sources, isolated failures, parallel writes."""

from __future__ import annotations

import json
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chartmill.columns import named
from chartmill.plans.charts import build_chart, from_cells, prepared
from chartmill.plans.fused import fused_cells, is_plain
from chartmill.plans.spec import check_spec
from chartmill.session import shared_dir
from chartmill.sizing import input_bytes, settled
from chartmill.sources.dates import PARSED_SUFFIX
from chartmill.sources.resolve import Sources
from chartmill.sources.sinks import delete_table, slug, write_dataset

CACHE_BYTES = 512 * 1024 * 1024
POOL = "spark.scheduler.pool"


class SharedSource:
    """A source of several charts: read with the columns they use, and a text file only once.

    Nothing runs before the first chart is built. Then a text file is cached if its size allows, and
    otherwise copied to a Parquet table in the shared folder. Plain charts with the same
    filters and derived columns are aggregated together, in one scan.
    """

    def __init__(self, df: DataFrame, is_text: bool, batch: Batch) -> None:
        self.df = df
        self._is_text, self._batch = is_text, batch
        self._uses: list[set[str]] = []
        self._lock = threading.Lock()
        self._shared: DataFrame | None = None
        self._broken: Exception | None = None
        self._plain: dict[str, list[Mapping[str, Any]]] = {}
        self._others = 0
        self._cells: dict[str, list[DataFrame] | None] = {}

    def plan(self, chart: Mapping[str, Any]) -> DataFrame:
        """The chart's dataset as a plan that runs nothing; notes the columns it reads."""
        dataset = build_chart(self.df, chart, large=False)
        if self._is_text:
            self._uses.append(columns_read(dataset))
        if is_plain(chart):
            self._plain.setdefault(_rows_of(chart), []).append(chart)
        else:
            self._others += 1
        return dataset

    def build(self, chart: Mapping[str, Any]) -> DataFrame:
        """The chart's dataset, planned for the size of its input; may run jobs."""
        with self._lock:
            if self._broken is not None:
                raise self._broken
            if self._shared is None:
                try:
                    self._shared = self._share()
                except Exception as problem:  # tried once, however many charts use it
                    self._broken = problem
                    raise
            rows = _rows_of(chart)
            alike = self._plain.get(rows, []) if is_plain(chart) else []
            if len(alike) > 1 and rows not in self._cells:
                self._cells[rows] = self._aggregated(alike)
        cells = self._cells.get(rows) if len(alike) > 1 else None
        if cells is None:
            return build_chart(self._shared, chart)
        return from_cells(cells[next(i for i, other in enumerate(alike) if other is chart)], chart)

    def _aggregated(self, charts: list[Mapping[str, Any]]) -> list[DataFrame] | None:
        """The cells of charts that read the same rows; None if their aggregation fails, so that each fails or works alone."""
        try:
            grouped, takers = fused_cells(prepared(self._shared, charts[0]), charts)
            table = settled(grouped)
            return [take(table) for take in takers]
        except Exception:
            return None

    def _share(self) -> DataFrame:
        if not self._is_text or len(self._plain) + self._others < 2:  # one scan
            return self.df
        used = set().union(*self._uses)
        needed = [name for name in self.df.columns if name in used or name.removesuffix(PARSED_SUFFIX) in used]
        df = self.df.select(*map(named, needed))
        if input_bytes(df) <= CACHE_BYTES:
            df = df.persist()
            self._batch.cached.append(df)
            return df
        path = f"{shared_dir(self._batch.spark)}/chartmill-{uuid.uuid4().hex}"
        self._batch.staged.append(path)
        write_dataset(df, path)
        return self._batch.spark.read.schema(df.schema).parquet(path)


@dataclass
class Batch:
    """The charts of a spec by name, and why the other ones failed.

    ``datasets`` are plans that have run nothing; ``build`` gives the dataset that counts and writes use,
    planned for the size of its input.
    """

    spark: SparkSession
    datasets: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    cached: list[DataFrame] = field(default_factory=list)
    staged: list[str] = field(default_factory=list)
    charts: dict[str, tuple[SharedSource, Mapping[str, Any]]] = field(default_factory=dict)

    def build(self, name: str) -> DataFrame:
        source, chart = self.charts[name]
        return source.build(chart)

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Release cached sources and delete the staged copies."""
        for df in self.cached:
            df.unpersist()
        self.cached.clear()
        for path in self.staged:
            delete_table(self.spark, path)
        self.staged.clear()


def _chart_name(chart: Mapping[str, Any], number: int, taken: Counter) -> str:
    title = chart.get("title") or f"chart {number}"
    name = f"{slug(title)}-{chart['type']}"
    taken[name] += 1
    return name if taken[name] == 1 else f"{name}-{taken[name]}"


def chart_batch(
    spark: SparkSession,
    spec: Mapping[str, Any],
    data: str | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> Batch:
    """Plan every chart of ``spec``; nothing runs yet.

    A broken spec is an error. A chart whose source or columns are missing is
    noted in ``errors`` and leaves the others alone. ``data`` replaces the
    spec's default source; ``tables`` offers DataFrames as named sources.

    Each source is opened once, and scanned with only the columns the charts
    need. A CSV used by several charts is not parsed for each of them: see ``SharedSource``.
    """
    check_spec(spec)
    block = spec.get("data") or {}
    sources = Sources(spark, block.get("default"), block.get("sources"), data, tables)
    batch = Batch(spark)
    taken: Counter = Counter()
    shared: dict[str, SharedSource] = {}
    broken: dict[str, Exception] = {}
    for number, chart in enumerate(spec["charts"], start=1):
        name = _chart_name(chart, number, taken)
        try:
            source = sources.pick(chart.get("data"))
            if source in broken:
                raise broken[source]
            if source not in shared:
                try:
                    shared[source] = SharedSource(sources.open(source), sources.is_text_file(source), batch)
                except Exception as problem:
                    broken[source] = problem
                    raise
            batch.datasets[name] = shared[source].plan(chart)
            batch.charts[name] = (shared[source], chart)
        except Exception as problem:  # one bad chart must not stop the others
            batch.errors[name] = _reason(problem)
    return batch


def _rows_of(chart: Mapping[str, Any]) -> str:
    """What decides which rows and columns a chart sees: equal for charts that can share a scan."""
    return json.dumps([chart.get("filter"), chart.get("derive")], sort_keys=True, default=str)


def columns_read(df: DataFrame) -> set[str]:
    """The columns that a plan's scans read, after pruning."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    outputs = [leaves.apply(i).output() for i in range(leaves.size())]
    return {output.apply(i).name() for output in outputs for i in range(output.size())}


def _reason(problem: Exception) -> str:
    """The first line of what went wrong in the end; Java wraps its causes."""
    text = str(problem)
    cause = getattr(problem, "java_exception", None) or getattr(problem, "_origin", None)
    for _ in range(20):
        inner = cause.getCause() if cause is not None else None
        if inner is None:
            break
        cause = inner
    if cause is not None and cause.getMessage():
        text = cause.getMessage()
    return next((line for line in text.split("\n") if line.strip()), type(problem).__name__)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(batch: Batch) -> DataFrame:
    """chart, n_rows for every planned chart, as one query; large medians and stacks run their jobs here."""
    counts = [
        batch.build(name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("chart"), "n_rows")
        for name in batch.datasets
    ]
    return _union(counts)


def batch_status(batch: Batch, parallel: int = 4) -> DataFrame:
    """chart, status, n_rows: 'ok' with the number of rows, or 'failed' with NULL, whenever a chart failed.

    Every chart is computed, on its own; one row per chart comes to the driver.
    """
    outcomes = _each_chart(batch, parallel, lambda name, df: Written(name, rows=df.count()))
    rows = [(outcome.name, "ok" if outcome.ok else "failed", outcome.rows) for outcome in outcomes]
    return batch.spark.createDataFrame(rows, "chart string, status string, n_rows long")


def long_form(batch: Batch) -> DataFrame:
    """All charts with x and y as one table: chart, x, series, y."""
    parts = []
    for name, planned in batch.datasets.items():
        if not {"x", "y"} <= set(planned.columns):
            continue
        df = batch.build(name)
        series = F.col("series").cast("string") if "series" in df.columns else F.lit(None).cast("string")
        parts.append(
            df.select(
                F.lit(name).alias("chart"),
                F.col("x").cast("string").alias("x"),
                series.alias("series"),
                F.col("y").cast("double").alias("y"),
            )
        )
    if not parts:
        raise ValueError("no chart of this batch has x and y")
    return _union(parts)


@dataclass
class Written:
    """Outcome of one chart: the path and number of rows, or the reason it failed."""

    name: str
    path: str | None = None
    rows: int | None = None
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


def _each_chart(batch: Batch, parallel: int, work: Callable[[str, DataFrame], Written]) -> list[Written]:
    """Build each chart and do ``work`` on it, several at a time; one that fails leaves the others alone."""

    def attempt(name: str) -> Written:
        batch.spark.sparkContext.setLocalProperty(POOL, name)
        try:
            return work(name, batch.build(name))
        except Exception as problem:  # reported, the other charts go on
            return Written(name, error=_reason(problem))
        finally:
            batch.spark.sparkContext.setLocalProperty(POOL, None)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as threads:
        outcomes = list(threads.map(inheritable_thread_target(batch.spark)(attempt), batch.datasets))
    return outcomes + [Written(name, error=reason) for name, reason in batch.errors.items()]


def write_batch(batch: Batch, out: str, fmt: str = "parquet", parallel: int = 4) -> list[Written]:
    """Write each dataset to ``out/<name>``, several at a time; report all outcomes.

    The charts run as concurrent Spark jobs from ``parallel`` driver threads,
    each in its own scheduler pool (fair where the session says so); that includes the
    jobs which large medians and stacks need before they can be planned. Rows are
    counted while they are written.
    """

    def write(name: str, df: DataFrame) -> Written:
        seen = Observation(name)
        write_dataset(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{out}/{name}", fmt)
        return Written(name, f"{out}/{name}", seen.get["rows"])

    return _each_chart(batch, parallel, write)
