"""The engine's queries on the test tables, each with an equivalent SQL text."""

from workload import batches, datasets, joins, periods, scalars, streams, tables  # noqa: F401  (they fill the registry)
from workload.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
