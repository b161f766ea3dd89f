"""Reading CSV and Parquet tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.columns import named
from chartmill.sources.dates import recognise_dates

# How a cell must be spelt to be read as a type. Numbers with leading zeros are identifiers.
_WHOLE = r"^[+-]?(0|[1-9]\d*)$"
_NUMBER = r"^[+-]?((0|[1-9]\d*)(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_MOMENT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?$"
#: Digits that a double keeps, and a decimal.
_DOUBLE_DIGITS, _DECIMAL_DIGITS = 17, 38


_WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _tests(guess: T.DataType, cell: Column) -> list[tuple[T.DataType, Column]]:
    """The types a column of the guessed type can have, in order of preference, each with its test of a cell.

    Spark's guess accepts more spellings than these types do, and none that it refuses.
    """
    digits = F.length(F.regexp_replace(F.regexp_replace(cell, "[eE].*$", ""), "[^0-9]", ""))
    few = lambda most: (F.length(cell) <= most) | (digits <= most)
    double = (T.DoubleType(), cell.rlike(_NUMBER) & few(_DOUBLE_DIGITS))
    if isinstance(guess, _WHOLE_TYPES):
        unsigned = F.when(F.substring(cell, 1, 1).isin("+", "-"), F.substring(cell, 2, 2)).otherwise(F.substring(cell, 1, 2))
        return [(T.LongType(), (F.substring(unsigned, 1, 1) != "0") | (unsigned == "0"))]
    if isinstance(guess, T.DecimalType):
        return [(T.DecimalType(_DECIMAL_DIGITS, 0), cell.rlike(_WHOLE) & few(_DECIMAL_DIGITS)), double]
    if isinstance(guess, T.DoubleType):
        return [double]
    boolean = (T.BooleanType(), cell.isin("true", "false"))
    if isinstance(guess, T.BooleanType):
        return [boolean]
    # what Spark took for a day or moment in another spelling
    if isinstance(guess, T.DateType):
        return [(T.DateType(), cell.rlike(_DAY))]
    if isinstance(guess, (T.TimestampType, T.TimestampNTZType)):
        return [(T.TimestampNTZType(), cell.rlike(_MOMENT))]
    # text, or files whose headers differ: those are reported when the table is read
    numeric = F.substring(cell, 1, 1).between("+", "9")
    return [
        (T.LongType(), numeric & cell.rlike(_WHOLE) & cell.try_cast("long").isNotNull()),
        (T.DecimalType(_DECIMAL_DIGITS, 0), numeric & cell.rlike(_WHOLE) & few(_DECIMAL_DIGITS)),
        (T.DoubleType(), numeric & double[1]),
        boolean,
        (T.DateType(), numeric & cell.rlike(_DAY) & cell.try_cast("date").isNotNull()),
        (T.TimestampNTZType(), numeric & cell.rlike(_MOMENT) & cell.try_cast("timestamp_ntz").isNotNull()),
    ]


def infer_schema(texts: DataFrame, guessed: T.StructType) -> T.StructType:
    """Types for an all-text table: per column the first type that fits every cell, else text.

    ``guessed`` is what Spark finds in all rows; one aggregation checks it cell by cell, and only its flags reach
    the driver. Empty cells fit any type, a column without others is text. Whole numbers beyond
    a long are decimals; numbers with leading zeros, or with more digits than a double keeps, stay text.
    """
    names = texts.columns
    tests = [(place, *test) for place, field in enumerate(guessed.fields) for test in _tests(field.dataType, named(names[place]))]
    if not tests:
        return T.StructType()
    # NULL where a column has no cell at all, else whether all of them fit
    flags = [F.bool_and(F.when(named(names[place]).isNotNull(), fits)).alias(f"c{i}") for i, (place, _, fits) in enumerate(tests)]
    chosen: dict[int, T.DataType] = {}
    for (place, kind, _), fits in zip(tests, texts.agg(*flags).first()):
        if fits:
            chosen.setdefault(place, kind)
    return T.StructType([T.StructField(name, chosen.get(i, T.StringType())) for i, name in enumerate(names)])


def _in_file_order(given: T.StructType, header: list[str]) -> T.StructType:
    """A schema for the columns as the file has them; columns that ``given`` lacks are text."""
    by_name = {field.name: field for field in given.fields}
    missing = [name for name in by_name if name not in header]
    if missing:
        raise ValueError(f"the file has no column {', '.join(missing)}; it has {', '.join(header)}")
    return T.StructType([by_name.get(name, T.StructField(name, T.StringType())) for name in header])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    header: bool = True,
    sep: str = ",",
    mode: str = "FAILFAST",
    multi_line: bool = False,
) -> DataFrame:
    """A CSV table, without date recognition.

    Quotes inside quoted cells are doubled, as in RFC 4180. Cells with line breaks need
    ``multi_line``, which reads every file as a whole, in one task. A ``schema`` saves the pass over
    all rows that finds the types otherwise; with a header its columns are found by name, in any order, and
    columns it does not name are left out. All files must have the columns of the first one, in
    its order. A cell that does not fit its type stops the query, so that no value is lost
    silently; ``mode="PERMISSIVE"`` turns it into NULL. Without a header the columns are called _c0, _c1, ...
    """
    options = {"header": header, "sep": sep, "escape": '"', "multiLine": multi_line}
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if given is None or header:
        texts = spark.read.options(**options).csv(path)
        if given is None:
            full = infer_schema(texts, spark.read.options(inferSchema=True, **options).csv(path).schema)
        else:
            full = _in_file_order(given, texts.columns)
        options["enforceSchema"] = False
    else:
        full = given
    df = spark.read.options(mode=mode, **options).schema(full).csv(path)
    return df if given is None else df.select(*map(named, given.fieldNames()))


def is_csv(path: str) -> bool:
    """True for names like a.csv and a.csv.gz."""
    return ".csv" in PurePosixPath(path).suffixes


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    header: bool = True,
    recognise: bool = True,
    fmt: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV or Parquet table with ``<column>_parsed`` dates added.

    The format is ``fmt`` or follows from the name: .csv is CSV, anything else
    Parquet.
    """
    if fmt is None:
        fmt = "csv" if is_csv(path) else "parquet"
    if fmt == "csv":
        df = read_csv(spark, path, schema, header, multi_line=multi_line)
    elif fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(path)
    else:
        raise ValueError(f"unknown table format '{fmt}'; supported: csv, parquet")
    return recognise_dates(df) if recognise else df


def column_list(df: DataFrame) -> list[str]:
    return df.columns
