"""Which table a chart reads."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from chartmill.operators.joins import join_sources
from chartmill.sources.tables import is_csv, read_table

Entry = str | Mapping[str, Any]

DEFAULT = "(default)"
JOIN_FIELDS = {"left", "right", "on", "how", "prefix"}


class Sources:
    """Named tables and paths; each is opened once and shared.

    ``default`` serves charts that name no source, ``override`` takes its place,
    ``named`` maps names to paths, ``tables`` maps names to DataFrames. A name
    is looked up in ``tables``, then in ``named``; anything else is a path.

    An entry of ``named`` may also be a mapping with ``path`` and any of
    ``schema``, ``header``, ``multi_line`` and ``fmt``, as ``read_table`` takes
    them. Large text files should come with a schema. The default may be such a mapping too.

    A mapping with ``left``, ``right`` and ``on`` is a join of two sources, each a name or a path, and
    takes ``how`` and ``prefix`` as ``join_sources`` does. Joins may build on joins. They are
    computed for each chart; nothing runs here.
    """

    def __init__(
        self,
        spark: SparkSession,
        default: Entry | None = None,
        named: Mapping[str, Entry] | None = None,
        override: str | None = None,
        tables: Mapping[str, DataFrame] | None = None,
    ) -> None:
        self._spark = spark
        self._named = dict(named or {})
        if isinstance(default, Mapping):
            self._named[DEFAULT] = default
            default = DEFAULT
        self._fallback = override or default
        self._tables = dict(tables or {})
        self._opened: dict[str, DataFrame] = {}
        self._joining: list[str] = []

    def pick(self, chart_source: str | None) -> str:
        """The name or path a chart uses: its own, else the override, else the default."""
        source = chart_source or self._fallback
        if not source:
            raise ValueError("no data source: neither the chart nor the spec names one")
        return source

    def _entry(self, source: str) -> dict[str, Any]:
        entry = self._named.get(source, source)
        return {"path": entry} if isinstance(entry, str) else dict(entry)

    def is_text_file(self, source: str) -> bool:
        """True for sources that are parsed anew on every scan; joins are not asked for."""
        if source in self._tables:
            return False
        entry = self._entry(source)
        return "path" in entry and (entry.get("fmt") == "csv" or is_csv(entry["path"]))

    def open(self, source: str) -> DataFrame:
        if source in self._tables:
            return self._tables[source]
        if source not in self._opened:
            entry = self._entry(source)
            self._opened[source] = read_table(self._spark, **entry) if "path" in entry else self._joined(source, entry)
        return self._opened[source]

    def _joined(self, source: str, entry: Mapping[str, Any]) -> DataFrame:
        missing = [field for field in ("left", "right", "on") if not entry.get(field)]
        unknown = sorted(set(entry) - JOIN_FIELDS)
        if missing or unknown:
            raise ValueError(
                f"source '{source}' needs a 'path', or 'left', 'right' and 'on'"
                + (f"; unknown: {', '.join(unknown)}" if unknown else "")
            )
        if source in self._joining:
            raise ValueError(f"source '{source}' is joined with itself: {' > '.join([*self._joining, source])}")
        self._joining.append(source)
        try:
            sides = self.open(entry["left"]), self.open(entry["right"])
        finally:
            self._joining.pop()
        return join_sources(*sides, entry["on"], entry.get("how", "left"), entry.get("prefix"))
