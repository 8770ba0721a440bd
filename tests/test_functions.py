from datetime import datetime

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakekit.functions import text
from lakekit.functions.bands import band, map_values, map_values_table
from lakekit.functions.types import type_kind


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "name, family, cycle",
    [
        ("pay_2024", "pay", 2024),
        ("a_2020_2024", "a_2020", 2024),
        ("pay", None, None),
        ("pay_20245", None, None),
        ("_2024", None, None),
        ("x_2024_", None, None),
        (None, None, None),
    ],
)
def test_name_suffix(spark, name, family, cycle):
    assert one(spark, name, "string", text.name_family) == family
    assert one(spark, name, "string", text.name_cycle) == cycle


def test_times_and_numbers(spark):
    assert one(spark, "2024-01-02T03:04:05Z", "string", text.iso_timestamp) == datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, "2024-01-02T03:04:05+02:00", "string", text.iso_timestamp) == datetime(2024, 1, 2, 1, 4, 5)
    for bad in ("never", "", None):
        assert one(spark, bad, "string", text.iso_timestamp) is None
    assert [one(spark, v, "string", text.int_or_null) for v in ("7", " 7 ", "", "x", None, "0")] == [7, 7, None, None, None, 0]


def test_paths(spark):
    path = "s3://b/partitioned/cycle=2022/form_family=F 3/_months/2022-01.done"
    assert one(spark, path, "string", lambda c: text.path_key(c, "cycle", "int")) == 2022
    assert one(spark, path, "string", lambda c: text.path_key(c, "form_family")) == "F 3"
    assert one(spark, path, "string", lambda c: text.path_key(c, "family")) is None
    assert one(spark, "cycle=x/a", "string", lambda c: text.path_key(c, "cycle", "int")) is None
    assert one(spark, path, "string", lambda c: text.strip_suffix(text.file_name(c), ".done")) == "2022-01"


def test_json_string(spark):
    assert one(spark, 'a "b"\\', "string", text.json_string) == '"a \\"b\\"\\\\"'


def test_hours_may_be_negative(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-01 01:30:00' AS b")
    assert df.select(text.hours_between(F.col("a"), F.col("b"))).first()[0] == -1.5


def test_map_prefix(spark):
    df = spark.sql("SELECT map('fs.a', '1', 'other', '2') AS m")
    assert df.select(text.map_with_prefix(F.col("m"), "fs.")).first()[0] == {"fs.a": "1"}
    assert df.select(text.map_get(F.col("m"), "none")).first()[0] is None


STEPS = [(None, "green"), (24, "yellow"), (72, "red")]


@pytest.mark.parametrize("value, label", [(-3.0, "green"), (23.99, "green"), (24.0, "yellow"), (72.0, "red"), (None, None)])
def test_band_edges(spark, value, label):
    assert one(spark, value, "double", lambda c: band(c, STEPS)) == label


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-200, 200), min_size=1, max_size=30))
def test_band_is_monotone(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    order = {"green": 0, "yellow": 1, "red": 2}
    got = [order[r[1]] for r in sorted((r.v, r.b) for r in df.withColumn("b", band(F.col("v"), STEPS)).collect())]
    assert got == sorted(got)


def test_band_rejects_bad_steps():
    with pytest.raises(ValueError):
        band(F.lit(1), [(0, "a")])
    with pytest.raises(ValueError):
        band(F.lit(1), [(None, "a"), (5, "b"), (5, "c")])


def test_value_mapping(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "v string")
    assert rows(df.select(map_values(F.col("v"), {"a": "x"}, "other"))) == [("other",), ("other",), ("x",)]
    codes = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "y")], "code string, label string")
    assert rows(map_values_table(df, "v", codes, "label")) == [(None, None), ("a", "w"), ("z", None)]


@pytest.mark.parametrize(
    "text_, kind",
    [
        ("decimal(10,2)", "DECIMAL"), ("VARCHAR(5)", "STRING"), ("char(1)", "STRING"), ("array<int>", "ARRAY"),
        ("map<string,int>", "MAP"), ("struct<a:int>", "STRUCT"), ("int", "INT"), ("BIGINT", "LONG"),
        ("smallint", "SHORT"), ("tinyint", "BYTE"), ("float", "FLOAT"), ("double", "DOUBLE"), ("string", "STRING"),
        ("boolean", "BOOLEAN"), ("date", "DATE"), ("timestamp", "TIMESTAMP"), ("timestamp_ntz", "TIMESTAMP_NTZ"),
        ("binary", "BINARY"), ("interval day to second", "OTHER"), ("variant", "OTHER"), ("void", "OTHER"), (None, None),
    ],
)
def test_type_kinds(spark, text_, kind):
    assert one(spark, text_, "string", type_kind) == kind
