"""Recognition of dates in text columns and of epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.columns import named

# Words in a column name that announce a date.
DATE_WORDS = (
    "date",
    "time",
    "timestamp",
    "created",
    "updated",
    "modified",
    "event_date",
    "session_date",
    "first_seen",
    "last_seen",
)

# Words in a column name that announce microseconds since 1970.
EPOCH_WORDS = ("timestamp", "_timestamp", "time_micros", "event_timestamp")

# The shapes of a date cell, with the places (counted from 1) of
# year, month and day. The form with slashes is month first; where a time of day
# follows, only the date is kept.
TEXT_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}.*)?$", (1, 6, 9)),
    (r"^\d{8}$", (1, 5, 7)),
    (r"^\d{2}/\d{2}/\d{4}$", (7, 1, 4)),
)
NUMBER_SHAPES = TEXT_SHAPES[1:2]

PARSED_SUFFIX = "_parsed"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
MICROSECOND = "INTERVAL '0.000001' SECOND"


def _mentions(name: str, words: tuple[str, ...]) -> bool:
    return any(word in name.lower() for word in words)


def is_date_like(name: str) -> bool:
    return _mentions(name, DATE_WORDS)


def is_epoch_like(name: str) -> bool:
    return _mentions(name, EPOCH_WORDS)


def as_date(text: Column, shapes=TEXT_SHAPES) -> Column:
    """The date in a cell of a known shape, else NULL; decided row by row."""
    cell = F.trim(text)
    iso = None
    for shape, (year, month, day) in shapes:
        parts = (F.substring(cell, year, 4), F.substring(cell, month, 2), F.substring(cell, day, 2))
        spelt = F.concat_ws("-", *parts)
        iso = F.when(cell.rlike(shape), spelt) if iso is None else iso.when(cell.rlike(shape), spelt)
    return iso.try_cast("date")


def _with_new(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """``df`` with the added columns, except where it has one of that name (in any case) already."""
    present = {name.lower() for name in df.columns}
    new = {name: column for name, column in added.items() if name.lower() not in present}
    return df.withColumns(new) if new else df


def parse_dates(df: DataFrame) -> DataFrame:
    """Add ``<column>_parsed`` dates for date-like text and YYYYMMDD number columns.

    A column of that name stays as it is.
    """
    added = {}
    for field in df.schema.fields:
        kind = field.dataType
        whole_number = isinstance(kind, (T.IntegerType, T.LongType))
        if not is_date_like(field.name) or (whole_number and is_epoch_like(field.name)):
            continue
        if isinstance(kind, T.StringType):
            added[field.name + PARSED_SUFFIX] = as_date(named(field.name))
        elif whole_number:
            added[field.name + PARSED_SUFFIX] = as_date(named(field.name).cast("string"), NUMBER_SHAPES)
    return _with_new(df, added)


def as_moment(micros: Column) -> Column:
    """Microseconds since 1970 as a zone-free timestamp, floored to the millisecond."""
    whole_millis = micros - F.pmod(micros, F.lit(1000).cast("long"))
    return F.expr(EPOCH) + F.expr(MICROSECOND) * whole_millis


def parse_epoch_micros(df: DataFrame) -> DataFrame:
    """Add ``<column>_parsed`` timestamps for long columns named like timestamps.

    A column of that name stays as it is.
    """
    added = {
        field.name + PARSED_SUFFIX: as_moment(named(field.name))
        for field in df.schema.fields
        if isinstance(field.dataType, T.LongType) and is_epoch_like(field.name)
    }
    return _with_new(df, added)


def recognise_dates(df: DataFrame) -> DataFrame:
    """Both kinds of recognition; unused columns are pruned from the plan."""
    return parse_epoch_micros(parse_dates(df))
