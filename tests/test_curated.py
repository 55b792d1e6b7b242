from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tests.conftest import Lake
from tidemark.operators.merge import encode_partitions, partition_predicate, restrict_to_partitions
from tidemark.plans.load import choose_mode

few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMA = "id int, v string, p string"

CASES = {
    "update in place": ([(1, "a", "p1")], [(1, "A", "p1")], [(1, "A", "p1")]),
    "insert": ([(1, "a", "p1")], [(2, "b", "p2")], [(1, "a", "p1"), (2, "b", "p2")]),
    "move partition": ([(3, "c", "p2"), (4, "d", "p1")], [(3, "C", "p1")], [(3, "C", "p1"), (4, "d", "p1")]),
    "null partition": ([(9, "z", None), (8, "y", None)], [(9, "Z", None)], [(8, "y", None), (9, "Z", None)]),
    "out of the null partition": ([(9, "z", None)], [(9, "Z", "p1")], [(9, "Z", "p1")]),
    "empty text partition": ([(8, "y", None)], [(9, "Z", "")], [(8, "y", None), (9, "Z", None)]),
    "text that stands for null": ([(8, "y", None)], [(9, "Z", "__HIVE_DEFAULT_PARTITION__")],
                                  [(8, "y", None), (9, "Z", None)]),
    "quote in value": ([(1, "a", "o'k")], [(1, "A", "o'k")], [(1, "A", "o'k")]),
    "odd value is emptied": ([(1, "a", "o'k \\ =/%#")], [(1, "A", "p")], [(1, "A", "p")]),
    "duplicate batch keys": ([(1, "a", "p1")], [(1, "x", "p1"), (1, "y", "p1")], [(1, "x", "p1"), (1, "y", "p1")]),
    "duplicate stored keys": ([(1, "a", "p1"), (1, "b", "p1")], [(2, "c", "p1")],
                              [(1, "a", "p1"), (1, "b", "p1"), (2, "c", "p1")]),
    "duplicate stored keys replaced": ([(1, "a", "p1"), (1, "b", "p2")], [(1, "c", "p1")], [(1, "c", "p1")]),
    "null key matches nothing": ([(None, "a", "p1")], [(None, "b", "p1")], [(None, "a", "p1"), (None, "b", "p1")]),
    "empty batch": ([(1, "a", "p1")], [], [(1, "a", "p1")]),
    "untouched partition": ([(1, "a", "p1"), (2, "b", "p2")], [(1, "A", "p1")], [(1, "A", "p1"), (2, "b", "p2")]),
}


WITHOUT_PARTITIONS = ("insert", "empty text partition", "duplicate batch keys", "duplicate stored keys replaced",
                      "null key matches nothing", "empty batch")


@pytest.mark.parametrize("case, partitions", [(c, "p") for c in CASES] + [(c, "None") for c in WITHOUT_PARTITIONS])
def test_merge(spark, lake, case, partitions):
    stored, batch, expected = CASES[case]
    if partitions == "None" and case == "empty text partition":
        expected = [(8, "y", None), (9, "Z", "")]
    spec = lake.mutable(partitions)
    lake.load(spec, spark.createDataFrame(stored, SCHEMA))
    lake.load(spec, spark.createDataFrame(batch, SCHEMA))
    assert lake.rows(spec, "id", "v", "p") == sorted(expected, key=repr)


def test_left_partition_has_no_files_and_untouched_ones_are_not_rewritten(spark, lake):
    spec = lake.mutable("p")
    lake.load(spec, spark.createDataFrame([(1, "a", "p1"), (2, "b", "p2"), (3, "c", "p3")], SCHEMA))
    before = lake.files(spec)
    lake.load(spec, spark.createDataFrame([(2, "B", "p1")], SCHEMA))
    after = lake.files(spec)
    assert not [f for f in after if f.startswith("p=p2/")]
    assert {f: t for f, t in after.items() if f.startswith("p=p3/")} == \
        {f: t for f, t in before.items() if f.startswith("p=p3/")}
    # Files do not come back with a later append to the emptied partition.
    lake.load(spec, spark.createDataFrame([(5, "e", "p2")], SCHEMA))
    assert lake.rows(spec, "id", "v", "p") == [(1, "a", "p1"), (2, "B", "p1"), (3, "c", "p3"), (5, "e", "p2")]


def test_merge_leaves_the_session_settings_alone(spark, lake):
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spec = lake.mutable("p")
    for v in "ab":
        lake.load(spec, spark.createDataFrame([(1, v, "p1")], SCHEMA))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    assert not Path(lake.layout.state(spec).removeprefix("file:"), "staging").exists()


row = st.tuples(st.integers(0, 6), st.sampled_from("abc"), st.sampled_from(["p1", "p2", None]))


@few
@given(stored=st.lists(row, min_size=1, max_size=8), batch=st.lists(row, max_size=8))
def test_merge_equals_the_dictionary_model(spark, stored, batch):
    lake = Lake(spark)
    stored = list({r[0]: r for r in stored}.values())
    batch = list({r[0]: r for r in batch}.values())
    expected = sorted({**{r[0]: r for r in stored}, **{r[0]: r for r in batch}}.values(), key=repr)
    for name, partitions in (("a", "p"), ("b", "None")):
        spec = lake.mutable(partitions, source_table_name=name)
        lake.load(spec, spark.createDataFrame(stored, SCHEMA))
        for _ in range(2):  # applying a batch twice equals once
            lake.load(spec, spark.createDataFrame(batch, SCHEMA))
        assert lake.rows(spec, "id", "v", "p") == expected


PARTITION_VALUES = {
    "int": (1, 2), "bigint": (-5, 7), "boolean": (True, False), "date": (date(2024, 1, 1), date(2024, 2, 29)),
    "timestamp_ntz": (datetime(2024, 1, 1, 1, 2, 3, 456789), datetime(2024, 3, 10, 2, 30)),
    "timestamp": (datetime(2024, 1, 1, 1, 2, 3, 456789), datetime(2024, 3, 10, 7, 30)),
    "decimal(10,2)": (Decimal("1.50"), Decimal("-2.25")), "double": (0.1, 2.0),
}


@pytest.mark.parametrize("kind", PARTITION_VALUES)
def test_partition_columns_of_any_type(spark, lake, kind):
    one, two = PARTITION_VALUES[kind]
    spec = lake.mutable("p")
    schema = f"id int, v string, p {kind}"
    lake.load(spec, spark.createDataFrame([(1, "a", one), (2, "b", two), (3, "c", None)], schema))
    lake.load(spec, spark.createDataFrame([(1, "A", two), (3, "C", two)], schema))
    assert lake.rows(spec, "id", "v", "p") == sorted([(1, "A", two), (2, "b", two), (3, "C", two)], key=repr)
    assert {f.split("/")[0] for f in lake.files(spec)} - {f"p={two}"} == set() or kind not in ("int", "bigint")
    assert lake.table(spec).read().schema["p"].dataType.simpleString() == kind


def test_partition_predicate_prunes_and_handles_nulls(spark, lake):
    spec = lake.mutable("p,q")
    rows = [(i, "v", f"p{i % 3}" if i % 3 else None, i % 2) for i in range(12)]
    lake.load(spec, spark.createDataFrame(rows, "id int, v string, p string, q int"))
    table = lake.table(spec).read()
    wanted = encode_partitions(table.filter("id in (0, 4)"), ["p", "q"]).distinct().collect()
    found = restrict_to_partitions(table, wanted, ["p", "q"])
    assert sorted(r.id for r in found.collect()) == [0, 4, 6, 10]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert table.filter(partition_predicate([], table.schema, ["p", "q"])).count() == 0


def test_combinations_of_partition_values_are_exact(spark, lake):
    spec = lake.mutable("p,q")
    rows = [(i, "v", f"p{i % 3}" if i % 3 else None, i % 2) for i in range(12)]
    lake.load(spec, spark.createDataFrame(rows, "id int, v string, p string, q int"))
    changed = [(0, "w", "p1", 0), (5, "w", None, 1), (12, "w", "p2", 7)]
    lake.load(spec, spark.createDataFrame(changed, "id int, v string, p string, q int"))
    kept = [r for r in rows if r[0] not in (0, 5)]
    assert lake.rows(spec, "id", "v", "p", "q") == sorted(kept + changed, key=repr)


@pytest.mark.parametrize("partitions, key", [("p", "p,id"), ("q,p", "p,id"), ("p,q", "id")])
def test_partition_columns_inside_the_key(spark, lake, partitions, key):
    spec = lake.mutable(partitions, key=key)
    schema = "id int, v string, p string, q string"
    lake.load(spec, spark.createDataFrame([(1, "a", "p1", "x"), (1, "b", "p2", "y"), (2, "c", "p1", "y")], schema))
    lake.load(spec, spark.createDataFrame([(1, "A", "p1", "y")], schema))
    expected = [(1, "A", "p1", "y"), (2, "c", "p1", "y")] + ([(1, "b", "p2", "y")] if "p" in key.split(",") else [])
    assert lake.rows(spec, "id", "v", "p", "q") == sorted(expected, key=repr)


def test_load_modes():
    assert {choose_mode(False, n, t) for n in ("mutable", "immutable") for t in ("full", "incremental")} == {"create"}
    assert choose_mode(True, "immutable", "incremental") == "append"
    assert choose_mode(True, "immutable", "full") == "replace"
    assert choose_mode(True, "mutable", "incremental") == "merge"
    assert choose_mode(True, "mutable", "full") == "replace"


@pytest.mark.parametrize("nature", ["mutable", "immutable"])
@pytest.mark.parametrize("partitions", ["None", "p", "p, v"])
def test_full_loads_replace_everything(spark, lake, nature, partitions):
    spec = lake.spec(nature_of_data=nature, target_partition_columns=partitions)
    assert lake.load(spec, spark.createDataFrame([(1, "a", "p1"), (2, "b", "p2")], SCHEMA)) == "create"
    assert lake.load(spec, spark.createDataFrame([(3, "c", "p1")], SCHEMA)) == "replace"
    assert lake.rows(spec, "id", "v", "p") == [(3, "c", "p1")]
    assert lake.load(spec, spark.createDataFrame([], SCHEMA)) is None  # an empty snapshot changes nothing
    assert lake.rows(spec, "id", "v", "p") == [(3, "c", "p1")]


def test_append_keeps_existing_files_and_adds_columns(spark, lake):
    spec = lake.spec(nature_of_data="immutable", type_of_pull="incremental", bookmark_key="id",
                     bookmark_key_order="asc", target_partition_columns="p")
    lake.load(spec, spark.createDataFrame([(1, "a", "p1")], SCHEMA))
    before = lake.files(spec)
    lake.load(spec, spark.createDataFrame([("p1", 2, {"k": [1]})], "p string, ID int, extra map<string,array<int>>"))
    assert before.items() <= lake.files(spec).items()
    assert lake.rows(spec, "id", "v", "extra", "p") == [(1, "a", None, "p1"), (2, None, {"k": [1]}, "p1")]


def test_merge_adds_columns_and_fills_missing_ones(spark, lake):
    spec = lake.mutable("p")
    lake.load(spec, spark.createDataFrame([(1, "a", "p1"), (2, "b", "p2")], SCHEMA))
    lake.load(spec, spark.createDataFrame([(1, "p1", 1.5)], "id int, p string, `odd name` double"))
    assert lake.rows(spec, "id", "v", "odd name", "p") == [(1, None, 1.5, "p1"), (2, "b", None, "p2")]


def test_purge(spark, lake):
    spec = lake.mutable("p")
    rows = spark.createDataFrame([(1, "a", "p1"), (2, "b", "p2"), (3, "c", None)], SCHEMA)
    lake.load(spec, rows)
    table = lake.table(spec)
    table.purge(F.col("p").isNull() | (F.col("p") == "p1"))
    assert lake.rows(spec, "id") == [(2,)]
    assert {f.split("/")[0] for f in lake.files(spec)} == {"p=p2"}
    table.purge()
    assert lake.rows(spec) == [] and not lake.files(spec)
    lake.load(spec, rows)
    assert lake.rows(spec, "id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("partitions", ["None", "p"])
def test_wider_values_fail_instead_of_being_cut(spark, lake, partitions):
    session = spark.newSession()
    session.conf.set("spark.sql.ansi.enabled", "false")
    merged = lake.mutable(partitions)
    appended = lake.spec(source_table_name="u", type_of_pull="incremental", nature_of_data="immutable",
                         bookmark_key="id", bookmark_key_order="asc", target_partition_columns=partitions)
    for spec in (merged, appended):
        lake.load(spec, session.createDataFrame([(1, "a", "p")], SCHEMA))
        with pytest.raises(Exception, match="OVERFLOW"):
            lake.load(spec, session.createDataFrame([(1 << 40, "a", "p")], "id bigint, v string, p string"))
        assert lake.rows(spec) == [(1, "a", "p")]
        lake.load(spec, session.createDataFrame([(2, "a", "p")], "id bigint, v string, p string"))
        assert lake.rows(spec) == [(1, "a", "p"), (2, "a", "p")]


@pytest.mark.parametrize("first, then", [("None", "p"), ("p", "None"), ("p", "p,v")])
def test_a_table_keeps_its_partitioning(spark, lake, first, then):
    lake.load(lake.mutable(first), spark.createDataFrame([(1, "a", "p")], SCHEMA))
    with pytest.raises(ValueError, match="is partitioned by"):
        lake.load(lake.mutable(then), spark.createDataFrame([(2, "a", "p")], SCHEMA))
    assert lake.rows(lake.mutable(first), "id") == [(1,)]


def test_partition_columns_may_be_given_in_another_order(spark, lake):
    lake.load(lake.mutable("p,v"), spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], SCHEMA))
    lake.load(lake.mutable("V,P"), spark.createDataFrame([(1, "b", "q")], SCHEMA))
    assert lake.rows(lake.mutable("p,v"), "id", "v", "p") == [(1, "b", "q"), (2, "b", "q")]


def test_struct_fields_are_aligned_by_name(spark, lake):
    spec = lake.mutable("p")
    inner = "struct<a:int,b:struct<x:int,y:string>>"
    lake.load(spec, spark.createDataFrame([(1, (1, (2, "y")), [(1, (2, "y"))], {"k": (1, (2, "y"))}, "p")],
                                          f"id int, s {inner}, l array<{inner}>, m map<string,{inner}>, p string"))
    turned = "struct<b:struct<y:string,x:bigint>,a:int>"
    value = (("why", 20), 10)
    lake.load(spec, spark.createDataFrame([(2, value, [value, None], {"k": value}, "p"), (3, None, None, None, "p")],
                                          f"id int, s {turned}, l array<{turned}>, m map<string,{turned}>, p string"))
    one = (10, (20, "why"))
    rows = {r.id: r for r in lake.table(spec).read().collect()}
    assert rows[2].s == one and rows[2].l == [one, None] and rows[2].m == {"k": one}
    assert rows[3].s is None and rows[3].l is None and rows[3].m is None and rows[1].s == (1, (2, "y"))
    lacking = spark.createDataFrame([(4, (7,), "p")], "id int, s struct<a:int>, p string")
    lake.load(spec, lacking)
    assert lake.table(spec).read().filter("id = 4").first().s == (7, None)
    # A field that the table lacks enters it, as a new column does.
    lake.load(spec, spark.createDataFrame([(5, (7, 8), "p")], "id int, s struct<a:int,z:int>, p string"))
    rows = {r.id: r.s for r in lake.table(spec).read().collect()}
    assert rows[5] == (7, None, 8) and rows[2] == (10, (20, "why"), None)
