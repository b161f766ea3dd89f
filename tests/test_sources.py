from __future__ import annotations

import datetime as dt

import pytest
from conftest import optimized, tuples
from pyspark.sql import types as T

import chartmill as cm
from chartmill.sizing import input_bytes, is_small
from chartmill.sources.dates import is_date_like, is_epoch_like
from chartmill.sources.sinks import slug


def write(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def kinds(df):
    return {name: kind for name, kind in df.dtypes}


def test_types_fit_all_rows(spark, tmp_path):
    path = write(
        tmp_path,
        "t.csv",
        "day,moment,n,ratio,flag,text,blank,code",
        "2023-12-01,2023-12-01 14:30:00,1,0.5,true,a,,007x",
        "2023-12-02,2023-12-02 09:15:30,,2,FALSE,12,,1",
        "2023-12-03,2023-12-03 16:45:12,-3,1e3,false,,,2",
    )
    df = cm.read_csv(spark, path)
    assert kinds(df) == {
        "day": "date",
        "moment": "timestamp_ntz",
        "n": "bigint",
        "ratio": "double",
        "flag": "string",
        "text": "string",
        "blank": "string",
        "code": "string",
    }
    assert df.first()["moment"] == dt.datetime(2023, 12, 1, 14, 30)


def test_the_order_of_rows_does_not_matter(spark, tmp_path):
    whole = [str(i) for i in range(1200)]
    for place in (0, 700, 1200):
        path = write(tmp_path, f"late{place}.csv", "n,blank", *[f"{n}," for n in [*whole[:place], "5.5", *whole[place:]]])
        assert kinds(cm.read_csv(spark, path)) == {"n": "double", "blank": "string"}
    path = write(tmp_path, "blank.csv", "n,blank", *[f"{n}," for n in whole], "1,5.5")
    assert kinds(cm.read_csv(spark, path)) == {"n": "bigint", "blank": "double"}


def test_identifiers_keep_every_digit(spark, tmp_path):
    path = write(
        tmp_path,
        "ids.csv",
        "zip,big,huge,mixed,zero,neg",
        "00501,12345678901234567891,1" + "0" * 40 + ",12345678901234567891,0,-0.5",
        "10001,12345678901234567892,2,5.5,-7,0.25",
    )
    df = cm.read_csv(spark, path)
    assert kinds(df) == {
        "zip": "string", "big": "decimal(38,0)", "huge": "string", "mixed": "string", "zero": "bigint", "neg": "double",
    }
    assert [str(row.big) for row in df.collect()] == ["12345678901234567891", "12345678901234567892"]
    assert [row.zip for row in df.collect()] == ["00501", "10001"]


def test_a_cell_that_does_not_fit_the_given_type(spark, tmp_path):
    path = write(tmp_path, "late.csv", "n", "1", "2", "n/a")
    assert kinds(cm.read_csv(spark, path)) == {"n": "string"}
    with pytest.raises(Exception, match="MALFORMED"):
        cm.read_csv(spark, path, schema="n BIGINT").collect()
    kept = cm.read_csv(spark, path, schema="n BIGINT", mode="PERMISSIVE")
    assert tuples(kept) == [(1,), (2,), (None,)]


def test_a_given_schema_is_matched_by_name(spark, tmp_path):
    path = write(tmp_path, "named.csv", "users,sessions,other", "1,20,x", "2,30,y")
    df = cm.read_csv(spark, path, schema="sessions BIGINT, users BIGINT")
    assert df.columns == ["sessions", "users"] and tuples(df) == [(20, 1), (30, 2)]
    with pytest.raises(ValueError, match="no column clicks"):
        cm.read_csv(spark, path, schema="users BIGINT, clicks BIGINT")
    bare = cm.read_csv(spark, path, schema="a STRING, b STRING, c STRING", header=False)
    assert bare.count() == 3


def test_too_many_fields_are_an_error(spark, tmp_path):
    path = write(tmp_path, "wide.csv", "date,users", "2023-12-01,1", "2023-12-02,2,3,4")
    with pytest.raises(Exception, match="MALFORMED"):
        cm.read_csv(spark, path).collect()


def test_files_with_other_columns_are_an_error(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    write(folder, "a.csv", "users,sessions", "1,2", "3,4")
    write(folder, "b.csv", "users,sessions", "5,6")
    assert cm.read_csv(spark, str(folder)).groupBy().sum("users").first()[0] == 9
    write(folder, "c.csv", "sessions,users", "8,7")
    with pytest.raises(Exception, match="header"):
        cm.read_csv(spark, str(folder)).groupBy().sum("users").collect()


def test_quoted_cells(spark, tmp_path):
    cells = ["Smith, A", 'say "hi"', 'say "hi", ok', '"', "back\\slash", " spaces ", ""]
    path = write(tmp_path, "q.csv", "name,n", *['"' + c.replace('"', '""') + f'",{i}' for i, c in enumerate(cells)])
    for schema in (None, "name STRING, n BIGINT"):
        assert [row.name or "" for row in cm.read_csv(spark, path, schema=schema).orderBy("n").collect()] == cells


def test_line_breaks_in_cells(spark, tmp_path):
    path = write(tmp_path, "m.csv", "name,n", '"two\nlines, ""quoted""",1', '"a\n\nb",2')
    df = cm.read_csv(spark, path, multi_line=True)
    assert tuples(df) == [('two\nlines, "quoted"', 1), ("a\n\nb", 2)]


def test_written_csv_is_read_alike_elsewhere(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ['say "hi", ok', "line\nbreak", "a,b", " lead", "trail ", "\\", '"', "plain", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n INT, t STRING")
    cm.write_dataset(rows, str(tmp_path / "out"), "csv")
    assert sorted(tuples(cm.read_csv(spark, str(tmp_path / "out"), multi_line=True, schema="n INT, t STRING"))) == list(enumerate(texts))
    found = duckdb.sql(f"SELECT n, t FROM read_csv('{tmp_path}/out/part-*.csv', header=true, quote='\"', escape='\"', delim=',')")
    assert sorted(found.fetchall()) == list(enumerate(texts))


def test_parsed_columns_are_not_overwritten(spark):
    rows = spark.createDataFrame([("2023-12-01", "mine", 5, "own")], "event_date STRING, Event_Date_Parsed STRING, event_timestamp BIGINT, event_timestamp_parsed STRING")
    assert tuples(cm.recognise_dates(rows).select(rows.columns)) == [("2023-12-01", "mine", 5, "own")]


def test_without_header(spark, tmp_path):
    path = write(tmp_path, "bare.csv", "2023-12-01,5,direct", "2023-12-02,6,search")
    df = cm.read_table(spark, path, header=False)
    assert kinds(df) == {"_c0": "date", "_c1": "bigint", "_c2": "string"}
    assert df.count() == 2


def test_given_schema_wins(spark, tmp_path):
    path = write(tmp_path, "s.csv", "a,b", "1,2")
    assert kinds(cm.read_table(spark, path, schema="a STRING, b DOUBLE")) == {"a": "string", "b": "double"}


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        cm.read_table(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize(
    ("name", "date_like", "epoch_like"),
    [
        ("date", True, False),
        ("Event_Date", True, False),
        ("first_seen", True, False),
        ("updatedBy", True, False),
        ("event_timestamp", True, True),
        ("time_micros", True, True),
        ("users", False, False),
    ],
)
def test_column_names(name, date_like, epoch_like):
    assert (is_date_like(name), is_epoch_like(name)) == (date_like, epoch_like)


def test_dates_of_all_shapes(spark):
    cells = {
        "2023-12-01": dt.date(2023, 12, 1),
        "2023-12-01 14:30:00": dt.date(2023, 12, 1),
        "2023-12-01 14:30:00.123": dt.date(2023, 12, 1),
        " 2023-12-01 ": dt.date(2023, 12, 1),
        "20231225": dt.date(2023, 12, 25),
        "12/25/2023": dt.date(2023, 12, 25),
        "25/12/2023": None,
        "2023/12/25": None,
        "2023-02-30": None,
        "2023-12-01T14:30:00": None,
        "yesterday": None,
        None: None,
    }
    rows = spark.createDataFrame([(cell,) for cell in cells], "created string")
    assert dict(tuples(cm.parse_dates(rows))) == cells


def test_numbers_as_dates(spark):
    rows = spark.createDataFrame([(20231201, 1), (20231301, 2), (5, 3), (None, 4)], "event_date long, users int")
    parsed = cm.parse_dates(rows)
    assert parsed.columns == ["event_date", "users", "event_date_parsed"]
    assert [row[2] for row in tuples(parsed)] == [dt.date(2023, 12, 1), None, None, None]


def test_epoch_micros(spark):
    rows = spark.createDataFrame([(1701435000000000,), (1701435000123999,), (-1,), (None,)], "event_timestamp long")
    assert [row[1] for row in tuples(cm.parse_epoch_micros(rows))] == [
        dt.datetime(2023, 12, 1, 12, 50),
        dt.datetime(2023, 12, 1, 12, 50, 0, 123000),
        dt.datetime(1969, 12, 31, 23, 59, 59, 999000),
        None,
    ]


def test_epoch_micros_do_not_depend_on_the_session_zone(spark):
    rows = spark.createDataFrame([(1701435000000000,)], "event_timestamp long")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert cm.parse_epoch_micros(rows).first()[1] == dt.datetime(2023, 12, 1, 12, 50)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_reading_recognises_dates(spark, tmp_path):
    path = write(
        tmp_path,
        "mixed.csv",
        "event_date,event_timestamp,created,users",
        "20231201,1701435000000000,12/01/2023,5",
        "20231202,1701507330000000,12/02/2023,6",
    )
    df = cm.read_table(spark, path)
    assert kinds(df)["event_date_parsed"] == "date"
    assert kinds(df)["event_timestamp_parsed"] == "timestamp_ntz"
    assert df.first()["created_parsed"] == dt.date(2023, 12, 1)
    assert cm.column_list(cm.read_table(spark, path, recognise=False)) == [
        "event_date",
        "event_timestamp",
        "created",
        "users",
    ]


def test_unused_recognised_dates_are_pruned(spark, tmp_path):
    path = write(tmp_path, "p.csv", "created,users", "12/01/2023,5")
    plan = optimized(cm.read_table(spark, path).select("users"))
    assert "created_parsed" not in plan


def test_nothing_to_recognise(spark):
    rows = spark.createDataFrame([(1, "a")], "users long, channel string")
    assert cm.recognise_dates(rows).columns == ["users", "channel"]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_sinks(spark, tmp_path, fmt):
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], "x string, y double")
    path = str(tmp_path / f"out.{fmt}")
    cm.write_dataset(rows, path, fmt)
    back = spark.read.schema(rows.schema).option("header", True).format(fmt).load(path)
    assert sorted(tuples(back)) == [("a", 1.5), ("b", None)]


def test_unknown_sink(spark):
    with pytest.raises(ValueError, match="png"):
        cm.write_dataset(spark.range(1), "/tmp/none", "png")


def test_slug():
    assert slug("Daily Users by Channel") == "daily-users-by-channel"
    assert slug("Users (2024): 50 %!") == "users-2024-50-"
    assert len(slug("x" * 80)) == 80


def test_input_size_is_not_below_the_files(spark, load):
    orders = load("orders")
    whole = input_bytes(orders)
    assert whole > 30_000
    assert input_bytes(orders.filter("o_orderkey = 1").select("o_orderkey")) >= whole


def test_size_of_exploded_rows_is_unknown(load):
    orders = load("orders")
    assert is_small(orders.groupBy("o_custkey").count())
    assert not is_small(orders.selectExpr("explode(sequence(1, o_custkey)) AS n"))


def test_explicit_struct_schema(spark, tmp_path):
    path = write(tmp_path, "e.csv", "d,n", "2023-12-01,1")
    schema = T.StructType([T.StructField("d", T.DateType()), T.StructField("n", T.LongType())])
    assert cm.read_table(spark, path, schema=schema).first()["d"] == dt.date(2023, 12, 1)
