"""Files sorted by key with Bloom filters: looking for a few keys reads little."""

import random
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators.merge import key_filter
from tidemark.plans.curated import CuratedTable


def rows_read(df):
    """Rows that the scans of a plan hand on, after pages and row groups were left out."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    leaves = plan.executedPlan().collectLeaves() if "Adaptive" in plan.getClass().getSimpleName() else plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def stored(spark, request):
    from tests.conftest import Lake
    lake = Lake(spark)
    specs = {}
    shuffled = (spark.range(300_000).select((F.col("id") * 2).alias("id"), F.md5(F.col("id").cast("string")).alias("v"))
                .withColumn("p", F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(2)))).orderBy(F.xxhash64("v")))
    for name, partitions in (("flat", "None"), ("parted", "p")):
        specs[name] = lake.mutable(partitions, source_table_name=name)
        lake.load(specs[name], shuffled)
    return lake, specs, shuffled


@pytest.mark.parametrize("name", ["flat", "parted"])
def test_few_pages_are_read_for_few_keys(spark, stored, name):
    lake, specs, shuffled = stored
    table = CuratedTable(spark, specs[name].database, specs[name].table, lake.layout.curated(specs[name]),
                         specs[name].partitions, lake.layout.state(specs[name]))._stored()
    keys = table.sparkSession.createDataFrame([(10,), (300_000,), (599_998,)], "id long")
    found = table.filter(key_filter(keys, ["id"])).select("id", "p")
    assert sorted(r.id for r in found.collect()) == [10, 300_000, 599_998]
    assert rows_read(found) <= 3 * 20_000 * 2 < 300_000
    # Keys that no row has, amid those that rows have: the Bloom filters leave out whole row groups.
    absent = table.sparkSession.createDataFrame([(11,), (299_001,), (500_001,)], "id long")
    assert rows_read(table.filter(key_filter(absent, ["id"])).select("id")) == 0


def test_a_merge_and_an_append_keep_files_sorted(spark, stored):
    lake, specs, shuffled = stored
    lake.load(specs["parted"], shuffled.filter("id % 1000 = 0").withColumn("v", F.lit("new")))
    table = lake.table(specs["parted"]).read()
    of_file = table.select("id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    ordered = of_file.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("i", "id"))).alias("rows")).select(
        F.col("rows.id").alias("ids")).collect()
    assert ordered and all(r.ids == sorted(r.ids) for r in ordered)


KINDS = {"bigint": st.integers(-1000, 1000), "string": st.text("abc", max_size=3), "double": st.floats(-5, 5),
         "date": st.dates(date(2000, 1, 1), date(2001, 1, 1)), "decimal(9,2)": st.decimals(-99, 99, places=2),
         "timestamp": st.datetimes(datetime(2024, 1, 1), datetime(2024, 6, 1))}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
@pytest.mark.parametrize("kind", KINDS)
def test_no_key_is_left_out(spark, kind, data):
    values = data.draw(st.lists(KINDS[kind] | st.none(), max_size=12))
    keys = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"k {kind}, n int")
    for options in ({}, {"most": 1, "groups": 3}):
        condition = key_filter(keys, ["k", "n"], **options)
        kept = keys.filter(condition) if condition is not None else keys
        assert sorted(r.n for r in kept.collect()) == [i for i, v in enumerate(values) if v is not None]


def test_ranges_leave_out_what_lies_between(spark):
    ids = [*range(0, 1000), *range(10**9, 10**9 + 1000)]
    random.Random(1).shuffle(ids)
    condition = key_filter(spark.createDataFrame([(i,) for i in ids], "id long"), ["id"])
    probe = spark.createDataFrame([(i,) for i in (5, 2000, 5 * 10**8, 10**9 + 5)], "id long")
    assert sorted(r.id for r in probe.filter(condition).collect()) == [5, 10**9 + 5]
    assert key_filter(spark.createDataFrame([([1],)], "id array<int>"), ["id"]) is None
