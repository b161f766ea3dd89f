"""Joins of two sources whose keys may be very uneven.

A sketch of the left side's keys finds those that would overfill a task. Only their rows are
salted, and only the matching rows of the right side are repeated, once per salt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.columns import named, type_of
from chartmill.sizing import is_small

JOIN_TYPES = ("inner", "left", "semi", "anti")
MAX_HEAVY = 4096  # keys that are salted at most; no more than n keys can hold more than 1 / n of the rows each
TRACKED = 16  # counters of the sketch for each key it may report
SPREAD_COLUMNS = 4  # columns that tell the rows of a heavy key apart; more would be read for nothing else

_WIDTHS = {"long": 8, "timestamp": 8, "timestamp_ntz": 8, "double": 8, "integer": 4, "date": 4, "float": 4, "short": 2}

Keys = str | Sequence[str] | Mapping[str, str]


def key_pairs(on: Keys) -> list[tuple[str, str]]:
    """(left, right) names of the key columns, from a name, a list of names or a mapping."""
    if isinstance(on, str):
        return [(on, on)]
    pairs = list(on.items()) if isinstance(on, Mapping) else [(name, name) for name in on]
    if not pairs:
        raise ValueError("a join needs at least one key column")
    return pairs


def _common_type(left: DataFrame, right: DataFrame, own: str, other: str) -> T.DataType:
    """The type both keys are compared in, as Spark coerces them; keys of different kinds are an error."""
    mine, theirs = type_of(left, own), type_of(right, other)
    if mine == theirs:
        return mine
    if isinstance(mine, T.StringType) != isinstance(theirs, T.StringType):
        raise ValueError(f"keys '{own}' ({mine.simpleString()}) and '{other}' ({theirs.simpleString()}) cannot be compared")
    return left.select(named(own)).union(right.select(named(other))).schema[0].dataType


def _key(name: str, kind: T.DataType) -> Column:
    """A key column such that equal keys have equal digests; 0.0 and -0.0 are equal."""
    column = named(name).cast(kind)
    return column + F.lit(0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else column


def _spreading(left: DataFrame) -> list[str]:
    """A few columns of fixed width, the widest first, to draw salts from."""
    widths = {
        field.name: 16 if isinstance(field.dataType, T.DecimalType) else _WIDTHS.get(field.dataType.typeName(), 0)
        for field in left.schema
    }
    return sorted((name for name in widths if widths[name]), key=lambda name: -widths[name])[:SPREAD_COLUMNS]


def _hashable(kind: T.DataType) -> bool:
    text = kind.simpleString()
    return "map<" not in text and "variant" not in text


def heavy_keys(digests: DataFrame, parts: int) -> DataFrame:
    """digest, salts for every key with more than 1 / ``parts`` of the rows: as many salts as it fills such parts.

    ``digests`` has one column, digest. Counts come from a frequent-items sketch
    that tasks fill on their own and merge; they are off by a small part of 1 / ``parts`` of all rows,
    which only moves the line between salted and other keys.
    """
    parts = max(2, min(parts, MAX_HEAVY))
    sketched = digests.agg(
        F.expr(f"approx_top_k(digest, {parts}, {parts * TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    return (
        sketched.select("n", F.inline("top"))
        .select(F.col("item").alias("digest"), F.ceil(F.col("count") * parts / F.col("n")).cast("int").alias("salts"))
        .filter("salts > 1")
    )


def join_sources(
    left: DataFrame,
    right: DataFrame,
    on: Keys,
    how: str = "left",
    prefix: str | None = None,
    large: bool | None = None,
) -> DataFrame:
    """The rows of ``left`` with the columns of ``right`` whose keys agree.

    ``on`` names the keys, as a mapping where the sides call them differently.
    ``how`` is inner, left, semi or anti; NULL keys match nothing. The columns are those of ``left``, then those of
    ``right`` without its keys, called ``prefix`` + name where a prefix is given. Names that both sides have are an
    error without one. Repeated keys on the right repeat the rows of the left, as in SQL.

    A small right side (``large`` answers in place of its measured size) is joined as it is,
    so that Spark can broadcast it. Otherwise keys with more than a partition's share of the left
    rows are salted. A row's salt depends on its content and partition alone, so a task that runs again
    gives each row the same salt, in whatever order rows reach it. The content is that of at most
    ``SPREAD_COLUMNS`` columns, so that a chart of few columns still reads few; rows equal in those stay together
    within a partition.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join '{how}'; supported: {', '.join(JOIN_TYPES)}")
    pairs = key_pairs(on)
    theirs = {name for _, name in pairs}
    kinds = [_common_type(left, right, own, other) for own, other in pairs]
    if not all(map(_hashable, kinds)):
        raise ValueError("maps and variants cannot be join keys")
    columns = [] if how in ("semi", "anti") else [name for name in right.columns if name not in theirs]
    added = {name: f"{prefix or ''}{name}" for name in columns}
    taken = {name.lower() for name in left.columns}
    clashes = [new for new in added.values() if new.lower() in taken]
    if clashes:
        raise ValueError(f"both sides have {', '.join(clashes)}; give a prefix for the columns of the right side")

    rows = left.select(
        *[named(name).alias(f"_a{i}") for i, name in enumerate(left.columns)],
        *[_key(own, kind).alias(f"_l{i}") for i, ((own, _), kind) in enumerate(zip(pairs, kinds))],
    )
    # keys that are NULL match nothing; they need not travel
    others = right.select(
        *[named(name).alias(f"_b{i}") for i, name in enumerate(columns)],
        *[_key(other, kind).alias(f"_r{i}") for i, ((_, other), kind) in enumerate(zip(pairs, kinds))],
    )
    condition = F.lit(True)
    for i in range(len(pairs)):
        others = others.filter(F.col(f"_r{i}").isNotNull())
        condition = condition & (F.col(f"_l{i}") == F.col(f"_r{i}"))
    if not is_small(right, large):
        rows, others = _salted(left, rows, others, len(pairs))
        condition = condition & (F.col("_lsalt") == F.col("_rsalt"))
    method = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    joined = rows.join(others, condition, method)
    own = [F.col(f"_a{i}").alias(name) for i, name in enumerate(left.columns)]
    return joined.select(*own, *[F.col(f"_b{i}").alias(added[name]) for i, name in enumerate(columns)])


def _salted(left: DataFrame, rows: DataFrame, others: DataFrame, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: rows of heavy keys get one, their partners all of them; others have 0."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = F.xxhash64(*[F.col(f"_l{i}") for i in range(n_keys)])
    theirs = F.xxhash64(*[F.col(f"_r{i}") for i in range(n_keys)])
    heavy = F.broadcast(heavy_keys(rows.select(mine.alias("digest")), parts))  # at most MAX_HEAVY rows
    content = [F.col(f"_a{left.columns.index(name)}") for name in _spreading(left)]
    spread = F.xxhash64(F.spark_partition_id(), *content)
    salts = F.coalesce(F.col("salts"), F.lit(1))
    salted = (
        rows.withColumn("digest", mine)
        .join(heavy, "digest", "left")
        .withColumn("_lsalt", F.pmod(spread, salts).cast("int"))
        .drop("digest", "salts")
    )
    repeated = (
        others.withColumn("digest", theirs)
        .join(heavy, "digest", "left")
        .withColumn("_rsalt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("digest", "salts")
    )
    return salted, repeated
