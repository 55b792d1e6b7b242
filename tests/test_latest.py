"""One version per key, and partitions as conditions on their columns."""

import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Row, functions as F

from tidemark.operators.latest import latest_by
from tidemark.operators.merge import encode_partitions, partition_predicate
from tidemark.sources.raw import append_files
from tidemark.streaming.new_files import load_new_files

SCHEMA = "id int, v string, version int, m map<string,int>"
few = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def versions(spark, rows, schema="id int, v string, version int"):
    return spark.createDataFrame(rows, schema)


@few
@given(st.lists(st.tuples(st.integers(0, 4) | st.none(), st.sampled_from("abc"), st.integers(0, 3) | st.none()), max_size=25))
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_latest_by_equals_sorting(spark, direction, rows):
    found = [tuple(r) for r in latest_by(versions(spark, rows), ["ID"], ["version"], direction).collect()]
    age = lambda r: (r[2] is not None, (r[2] or 0) * (1 if direction == "asc" else -1))
    best = {}
    for r in rows:
        if r[0] is not None:
            best.setdefault(r[0], []).append(r)
    assert sorted(r[0] for r in found if r[0] is not None) == sorted(best)
    for r in found:
        if r[0] is not None:
            assert r in best[r[0]] and age(r) == max(map(age, best[r[0]]))
    assert sorted((r for r in found if r[0] is None), key=repr) == sorted((r for r in rows if r[0] is None), key=repr)


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 3, v, 1, {"k": n}) for i, (v, n) in enumerate((v, n) for v in "abcdef" for n in range(4))]
    found = set()
    for n in (1, 3, 7):
        random.Random(n).shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA).repartition(n)
        found.add(str(sorted(map(str, latest_by(df, ["id"], ["version"]).collect()))))
    assert len(found) == 1


def test_no_window_and_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    plan = latest_by(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1 and "partial_max_by" in plan


def test_a_bad_direction_is_refused(spark):
    with pytest.raises(ValueError):
        latest_by(versions(spark, []), ["id"], ["version"], "down")


@pytest.mark.parametrize("direction, wanted", [("asc", "new"), ("desc", "old")])
def test_files_that_hold_several_versions(spark, lake, direction, wanted):
    spec = lake.spec(
        type_of_pull="incremental", bookmark_key="version", bookmark_key_order=direction, primary_key="id")
    schema = "id int, v string, version int"
    for row in ((1, "old", 1), (1, "new", 2), (2, "only", 5)):
        append_files(versions(spark, [row]), lake.layout.raw(spec))
    load_new_files(spark, spec, lake.layout, schema)
    assert lake.rows(spec, "id", "v") == [(1, wanted), (2, "only")]


VALUES = {"p": ["o'k", "50%", "", None, "~", "3:abc"], "q": [1, -5, None], "r": [datetime(2024, 1, 1, 1, 2, 3, 5), None]}


@few
@given(st.sets(st.tuples(*(st.sampled_from(v) for v in VALUES.values())), max_size=30))
def test_tuples_as_a_tree_are_exact(spark, tuples):
    every = [(p, q, r) for p in VALUES["p"] for q in VALUES["q"] for r in VALUES["r"]]
    df = spark.createDataFrame(every, "p string, q int, r timestamp")
    names = list(VALUES)
    wanted = spark.createDataFrame(list(tuples), df.schema) if tuples else df.limit(0)
    values = encode_partitions(wanted, names).collect()
    found = df.filter(partition_predicate(values, df.schema, names)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(tuples, key=repr)


def test_many_tuples_stay_conditions_on_columns(spark, tmp_path):
    df = spark.range(1).select(F.lit("a").alias("p"), F.lit("b").alias("q"), F.lit(1).alias("r"), F.lit(1).alias("x"))
    df.write.partitionBy("p", "q", "r").parquet(str(tmp_path / "t"))
    table = spark.read.schema("x int, p string, q string, r int").parquet(str(tmp_path / "t"))
    full = [Row(p=f"m{i}", q=q, r=str(r)) for i in range(79) for q in ("F", "O", None) for r in range(5)]
    odd = [Row(p="m500", q="it's", r=None), Row(p=None, q="F", r="2")]
    text = table.filter(partition_predicate(full + odd, table.schema, ["p", "q", "r"]))._jdf.queryExecution() \
        .optimizedPlan().toString()
    condition = text[text.index("Filter"):].split("\n")[0]
    assert "concat" not in condition and " IN " in condition or "INSET" in condition
    assert condition.count(" OR ") < 12  # 1,187 tuples in a few branches
