from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions import (
    allowed, decode, encode, lex_gt, lex_lt, not_blank, positive, requires, split_columns,
    split_columns_of, violation,
)
from tidemark.operators import high_water, low_water, row_counts, validate, write_report
from tidemark.operators.validate import passed, require_clean

few = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
triple = st.tuples(*[st.integers(0, 2)] * 3)


@few
@given(rows=st.lists(triple, min_size=1, max_size=20), mark=triple, width=st.integers(1, 3))
def test_lexicographic_compare_equals_tuple_compare(spark, rows, mark, width):
    keys = ["a", "b", "c"][:width]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    literals = [F.lit(v) for v in mark[:width]]
    above = sorted(tuple(r) for r in df.filter(lex_gt(keys, literals)).collect())
    below = sorted(tuple(r) for r in df.filter(lex_lt(keys, literals)).collect())
    assert above == sorted(r for r in rows if r[:width] > mark[:width])
    assert below == sorted(r for r in rows if r[:width] < mark[:width])


def test_rows_whose_comparison_is_unknown_are_not_pulled(spark):
    df = spark.createDataFrame([(None, 5), (1, None), (2, None), (1, 9)], "a int, b int")
    found = df.filter(lex_gt(["a", "b"], [F.lit(1), F.lit(3)])).collect()
    assert sorted(map(tuple, found), key=repr) == [(1, 9), (2, None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
@pytest.mark.parametrize("data_type, text", [
    ("timestamp_ntz", "2024-03-10 02:30:00.123457"), ("timestamp", "2024-11-03 01:30:00.123457"),
    ("date", "2024-02-29"), ("decimal(20,3)", "12345678901234567.125"), ("double", "0.1"),
    ("bigint", "-9223372036854775808"), ("string", "o'k \\ \"q\""), ("boolean", "true"),
])
def test_values_survive_the_trip_as_literals(spark, zone, data_type, text):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", zone)
    df = session.createDataFrame([(text,)], "t string").select(F.col("t").cast(data_type).alias("v"))
    kind = df.schema["v"].dataType
    encoded = df.select(encode(F.col("v"), kind)).first()[0]
    assert df.filter(F.col("v") == decode(encoded, kind)).count() == 1
    assert df.filter(F.col("v") > decode(encoded, kind)).count() == 0


def test_null_literal(spark):
    kind = spark.range(1).schema["id"].dataType
    assert spark.range(1).select(decode(None, kind).alias("v")).first()["v"] is None


def test_water_marks_use_native_types_and_skip_nulls(spark):
    df = spark.createDataFrame([(i, "x") for i in range(12)] + [(None, "z"), (99, None)], "a int, b string")
    assert high_water(df, ["a"]).first()["a"] == 99
    assert tuple(high_water(df, ["a", "b"]).first()) == (11, "x")
    assert tuple(low_water(df, ["a", "b"]).first()) == (0, "x")
    assert tuple(high_water(df.filter("a is null"), ["a", "b"]).first()) == (None, None)


def test_column_lists(spark):
    assert split_columns(" a, b ,,c") == ["a", "b", "c"] and split_columns(None) == []
    df = spark.createDataFrame([(" a, b ,,c",), (None,)], "t string")
    assert [r[0] for r in df.select(split_columns_of("t")).collect()] == [["a", "b", "c"], []]


def test_every_violated_rule_is_reported_once(spark):
    df = spark.createDataFrame(
        [(1, "a", "1", "x"), (2, "q", "0", " "), (3, None, None, None), (4, "a", "many", "x")],
        "id int, kind string, size string, name string")
    rules = [allowed("kind", ["a", "b"], "kind"), positive("size", "size"), not_blank("name", "name"),
             violation(F.col("id") > 3, "id"), requires(F.col("kind") == "a", F.col("size") == "1", "both")]
    report = validate(df, ["id"], rules)
    assert {r.id: r.errors for r in report.collect()} == {
        2: "kind, size, name", 3: "kind, size, name", 4: "size, id, both"}
    assert "Exchange" not in report._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        require_clean(report)
    assert passed(report).first()["passed"] is False
    clean = validate(df.filter("id = 1"), ["id"], rules)
    require_clean(clean)
    assert passed(clean).first()["passed"] is True


def test_report_file_is_bar_separated_with_a_header(spark, tmp_path):
    df = spark.createDataFrame([("s", "t", "e1, e2")], "source_schema_name string, source_table_name string, Errors string")
    write_report(df.coalesce(1), str(tmp_path / "r"))
    lines = [line for f in (tmp_path / "r").glob("*.csv") for line in f.read_text().splitlines()]
    assert lines == ["source_schema_name|source_table_name|Errors", "s|t|e1, e2"]


def test_row_counts_in_one_job(spark):
    counts = row_counts({"a": spark.range(3), "b": spark.range(0)})
    assert {r.table_name: r.n for r in counts.collect()} == {"a": 3, "b": 0}


def test_timestamps_are_not_cut_to_milliseconds(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 12, 194062),)], "ts timestamp_ntz")
    kind = df.schema["ts"].dataType
    text = high_water(df, ["ts"]).select(encode(F.col("ts"), kind)).first()[0]
    assert df.filter(lex_gt(["ts"], [decode(text, kind)])).count() == 0
