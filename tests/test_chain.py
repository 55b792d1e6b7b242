from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_crash import Crash, crash_after
from tidemark import TableSpec, pull, pull_to_raw, run_all, run_table
from tidemark.plans.bookmarks import bookmark, log_entries, next_batch_id
from tidemark.plans.curated import CuratedTable
from tidemark.plans import chain
from tidemark.sources.raw import append_files, batches, land, raw_scan
from tidemark.storage import delete
from tidemark.streaming import load_logged_batches, load_new_files

SCHEMA = "id int, v string, p string"


def keys_of(df, spec):
    return [df.schema[k] for k in spec.bookmark_keys]


def appended(lake, keys="id", order="asc", **values):
    return lake.spec(type_of_pull="incremental", nature_of_data="immutable", bookmark_key=keys,
                     bookmark_key_order=order, **values)


def test_bookmarks_are_compared_as_numbers_and_skip_nulls(spark, lake):
    spec = appended(lake)
    rows = spark.range(12).select(F.col("id").cast("int"), F.lit("v").alias("v"), F.lit("p").alias("p"))
    source = rows.unionByName(spark.createDataFrame([(None, "n", "p")], SCHEMA))
    assert pull_to_raw(spark, spec, lake.layout, "wf", source) == "000000000001"
    log = lake.layout.bookmarks(spec, "wf")
    assert bookmark(spark, log, keys_of(source, spec)).first()["id"] == 11
    assert pull(spark, spec, lake.layout, "wf", source).count() == 0
    # Nothing new: neither data nor a log row, and the number is not used up.
    assert pull_to_raw(spark, spec, lake.layout, "wf", source) is None
    assert next_batch_id(spark, log) == "000000000002"


def test_a_batch_without_any_key_keeps_the_old_bookmark(spark, lake):
    spec = appended(lake)
    log = lake.layout.bookmarks(spec, "wf")
    first = spark.createDataFrame([(5, "a", "p")], SCHEMA)
    pull_to_raw(spark, spec, lake.layout, "wf", first)
    from tidemark.plans.bookmarks import save_bookmark
    nulls = land(spark.createDataFrame([(None, "b", "p")], SCHEMA), lake.layout.raw(spec, "wf"), "000000000002")
    save_bookmark(nulls, log, "000000000002", ["id"], "asc")
    assert bookmark(spark, log, keys_of(first, spec)).first()["id"] == 5
    assert {r.batch_id: r.n_rows for r in log_entries(spark, log).collect()} == {
        "000000000001": 1, "000000000002": 1}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_microsecond_bookmarks_in_any_time_zone(spark, lake, zone, kind):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", zone)
    rows = session.createDataFrame([(datetime(2024, 3, 10, 2, 30, 12, 194062), 1)], f"ts {kind}, id int")
    spec = appended(lake, "ts")
    pull_to_raw(session, spec, lake.layout, "wf", rows)
    assert pull(session, spec, lake.layout, "wf", rows).count() == 0
    later = rows.withColumn("ts", F.col("ts") + F.expr("interval 1 microsecond"))
    assert pull(session, spec, lake.layout, "wf", later).count() == 1


@pytest.mark.parametrize("order, expected", [("asc", [(2, 2)]), ("desc", [(1, 1)])])
def test_composite_bookmark(spark, lake, order, expected):
    spec = appended(lake, "a, b", order)
    source = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "a int, b int")
    seen = source.filter("not (a = 2 and b = 2)" if order == "asc" else "not (a = 1 and b = 1)")
    pull_to_raw(spark, spec, lake.layout, "wf", seen)
    assert [tuple(r) for r in pull(spark, spec, lake.layout, "wf", source).collect()] == expected


def test_a_retried_pull_lands_once(spark, lake, monkeypatch):
    spec = appended(lake)
    source = spark.createDataFrame([(1, "a", "p")], SCHEMA)
    monkeypatch.setattr(chain, "save_bookmark", lambda *a: (_ for _ in ()).throw(Crash()))
    with pytest.raises(Crash):
        run_table(spark, spec, lake.layout, "wf", source)
    monkeypatch.undo()
    assert not lake.table(spec).exists()  # a failed pull is not loaded
    run_table(spark, spec, lake.layout, "wf", source)
    assert raw_scan(spark, lake.layout.raw(spec, "wf")).count() == 1
    assert lake.rows(spec) == [(1, "a", "p")]


def test_unread_increments_are_merged_in_order(spark, lake):
    spec = lake.mutable("p")
    for version in "abc":
        rows = spark.createDataFrame([(1, version, "p1"), (ord(version), version, "p2")], SCHEMA)
        spec_all = lake.mutable("p")
        batch_id = next_batch_id(spark, lake.layout.bookmarks(spec_all, "wf"))
        from tidemark.plans.bookmarks import save_bookmark
        landed = land(rows, lake.layout.raw(spec, "wf"), batch_id)
        save_bookmark(landed, lake.layout.bookmarks(spec, "wf"), batch_id, ["id"], "asc")
    assert load_logged_batches(spark, spec, lake.layout, "wf") == ["create", "merge", "merge"]
    assert lake.rows(spec, "id", "v") == [(1, "c"), (97, "a"), (98, "b"), (99, "c")]
    assert load_logged_batches(spark, spec, lake.layout, "wf") == []


def test_of_unread_full_pulls_the_newest_counts(spark, lake):
    spec = lake.spec()
    for version in "abc":
        pull_to_raw(spark, spec, lake.layout, "wf", spark.createDataFrame([(1, version, "p")], SCHEMA))
    assert load_logged_batches(spark, spec, lake.layout, "wf") == ["create"]
    assert lake.rows(spec) == [(1, "c", "p")]


def test_a_batch_that_is_still_landing_is_not_lost(spark, lake):
    spec = appended(lake)
    run_table(spark, spec, lake.layout, "wf", spark.createDataFrame([(1, "a", "p")], SCHEMA))
    landed = land(spark.createDataFrame([(2, "b", "p")], SCHEMA), lake.layout.raw(spec, "wf"), "000000000002")
    assert load_logged_batches(spark, spec, lake.layout, "wf") == []
    from tidemark.plans.bookmarks import save_bookmark
    save_bookmark(landed, lake.layout.bookmarks(spec, "wf"), "000000000002", ["id"], "asc")
    assert load_logged_batches(spark, spec, lake.layout, "wf") == ["append"]
    assert lake.rows(spec, "id") == [(1,), (2,)]


@pytest.mark.parametrize("owner, name", [(CuratedTable, "append"), (CuratedTable, "_refresh")])
def test_a_failed_load_is_repeated_by_the_next_run(spark, lake, monkeypatch, owner, name):
    spec = appended(lake)
    run_table(spark, spec, lake.layout, "wf", spark.createDataFrame([(1, "a", "p")], SCHEMA))
    crash_after(monkeypatch, owner, name)
    both = spark.createDataFrame([(1, "a", "p"), (2, "b", "p")], SCHEMA)
    with pytest.raises(Exception, match="Crash"):
        run_table(spark, spec, lake.layout, "wf", both)
    result = run_table(spark, spec, lake.layout, "wf", both)
    assert result.batch_id is None and result.modes == ("append",)
    assert lake.rows(spec, "id", "v", "p") == [(1, "a", "p"), (2, "b", "p")]


def test_new_columns_of_the_source_reach_the_table(spark, lake):
    spec = lake.mutable("p")
    run_table(spark, spec, lake.layout, "wf", spark.createDataFrame([(1, "a", "p1")], SCHEMA))
    wider = spark.createDataFrame([(2, "b", "p1", 7)], SCHEMA + ", extra int")
    run_table(spark, spec, lake.layout, "wf", wider)
    assert lake.rows(spec, "id", "v", "extra", "p") == [(1, "a", None, "p1"), (2, "b", 7, "p1")]


def test_a_failing_table_stops_only_itself(spark, lake):
    good = appended(lake, source_table_name="good")
    bad = appended(lake, "missing", source_table_name="bad")
    source = spark.createDataFrame([(1, "a", "p")], SCHEMA)
    results = run_all(spark, [bad, good], lake.layout, "wf", {"s.good": source, "s.bad": source})
    assert results[0].error and not results[1].error
    assert not lake.table(bad).exists() and lake.rows(good) == [(1, "a", "p")]


def test_a_catalogued_table_is_a_source(spark, lake):
    name = f"src_{lake.database}"
    spark.createDataFrame([(1, "a", "p")], SCHEMA).createOrReplaceTempView(name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {lake.database} LOCATION '{lake.layout.root}/db'")
    spark.table(name).write.saveAsTable(f"{lake.database}.source_t")
    spec = lake.spec(catalog_db_name=lake.database, catalog_table_name="source_t")
    run_table(spark, spec, lake.layout, "wf")
    assert lake.rows(spec) == [(1, "a", "p")]


def test_foreign_files_are_loaded_once(spark, lake):
    spec = appended(lake)
    raw = lake.layout.raw(spec)
    for i in range(2):
        append_files(spark.createDataFrame([(i, "a", "p")], SCHEMA), raw)
        load_new_files(spark, spec, lake.layout, SCHEMA)
        load_new_files(spark, spec, lake.layout, SCHEMA)
    # A column appears: the declared schema may grow between runs.
    append_files(spark.createDataFrame([(2, "a", "p", 5)], SCHEMA + ", extra int"), raw)
    load_new_files(spark, spec, lake.layout, SCHEMA + ", extra int")
    assert lake.rows(spec, "id", "extra") == [(0, None), (1, None), (2, 5)]


def test_batch_ids_stay_text(spark, lake):
    raw = lake.layout.raw(lake.spec())
    land(spark.createDataFrame([(1, "a", "p")], SCHEMA), raw, "000000000001")
    assert batches(spark, raw).select("batch_id").first()[0] == "000000000001"
    assert raw_scan(spark, raw).columns == ["id", "v", "p"]


def test_equal_table_names_can_be_told_apart(lake):
    spec = TableSpec("a-b", "orders", "curated-db", target_table_name="a_orders")
    assert (spec.database, spec.table) == ("curated_db", "a_orders")


def test_names_in_another_case_and_with_dots(spark, lake):
    spec = lake.spec(type_of_pull="incremental", bookmark_key="VERSION", bookmark_key_order="asc",
                     primary_key="ID", target_partition_columns="P")
    schema = "id int, `a.b` string, `c d` string, p string, version int"
    run_table(spark, spec, lake.layout, "wf", spark.createDataFrame([(1, "x", "y", "p1", 1)], schema))
    both = spark.createDataFrame([(1, "x", "y", "p1", 1), (1, "X", "Y", "p2", 2)], schema)
    assert run_table(spark, spec, lake.layout, "wf", both).modes == ("merge",)
    assert lake.rows(spec, "id", "`a.b`", "`c d`", "p", "version") == [(1, "X", "Y", "p2", 2)]


def test_a_missing_column_is_named(spark, lake):
    with pytest.raises(ValueError, match="no such column: nope"):
        lake.load(lake.mutable("nope"), spark.createDataFrame([(1, "a", "p")], SCHEMA))


def test_batch_folders_can_be_read_as_plain_files(spark, lake):
    spec = appended(lake)
    for i in range(2):
        land(spark.createDataFrame([(i, "a", "p")], SCHEMA), lake.layout.raw(spec), f"00000000000{i}")
        load_new_files(spark, spec, lake.layout, SCHEMA)
    assert lake.table(spec).read().columns == ["id", "v", "p"]
    assert lake.rows(spec, "id") == [(0,), (1,)]


def test_rows_are_counted(spark, lake):
    spec = appended(lake)
    rows = spark.createDataFrame([(i, "a", "p") for i in range(3)], SCHEMA)
    result = run_table(spark, spec, lake.layout, "wf", rows)
    assert (result.rows_pulled, result.rows_loaded) == (3, 3)
    again = run_table(spark, spec, lake.layout, "wf", rows)
    assert (again.batch_id, again.rows_pulled, again.rows_loaded) == (None, 0, 0)


@pytest.mark.parametrize("pull_type", ["incremental", "full"])
def test_a_lost_checkpoint_doubles_nothing(spark, lake, pull_type):
    spec = appended(lake) if pull_type == "incremental" else lake.spec(nature_of_data="immutable")
    for i in range(1, 4):
        pull_to_raw(spark, spec, lake.layout, "wf", spark.createDataFrame([(n, "a", "p") for n in range(i)], SCHEMA))
    load_logged_batches(spark, spec, lake.layout, "wf")
    delete(spark, lake.layout.checkpoint(spec, "wf"))
    pull_to_raw(spark, spec, lake.layout, "wf", spark.createDataFrame([(n, "a", "p") for n in range(5)], SCHEMA))
    assert len(load_logged_batches(spark, spec, lake.layout, "wf")) == 1
    assert lake.rows(spec, "id") == [(n,) for n in range(5)]


def test_workflows_keep_their_batches_apart(spark, lake):
    spec = appended(lake)
    pull_to_raw(spark, spec, lake.layout, "w1", spark.createDataFrame([(n, "a", "p") for n in range(5)], SCHEMA))
    pull_to_raw(spark, spec, lake.layout, "w2", spark.createDataFrame([(n, "a", "p") for n in (100, 101)], SCHEMA))
    for workflow in ("w1", "w2"):
        load_logged_batches(spark, spec, lake.layout, workflow)
    assert sorted(lake.rows(spec, "id")) == [(0,), (1,), (2,), (3,), (4,), (100,), (101,)]


@pytest.mark.parametrize("other", [dict(source_schema_name="z"), dict(target_table_name="T ", source_table_name="t2")])
def test_colliding_specs_do_not_run(spark, lake, other):
    spec = lake.spec()
    second = replace(spec, **other)
    with pytest.raises(ValueError, match="the same target"):
        run_all(spark, [spec, second], lake.layout, "wf")
    with pytest.raises(ValueError, match="the same source"):
        run_all(spark, [spec, replace(spec, target_table_name="u")], lake.layout, "wf")
    assert not lake.table(spec).exists()


def test_a_type_change_between_unread_batches(spark, lake):
    spec = appended(lake)
    pull_to_raw(spark, spec, lake.layout, "wf", spark.createDataFrame([(1, "a", "p")], SCHEMA))
    wider = spark.createDataFrame([(1, "a", "p"), (2, "b", "p")], SCHEMA.replace("id int", "id bigint"))
    pull_to_raw(spark, spec, lake.layout, "wf", wider)
    assert load_logged_batches(spark, spec, lake.layout, "wf") == ["create", "append"]
    assert lake.rows(spec, "id") == [(1,), (2,)]


def test_full_pulls_need_batches(spark, lake):
    with pytest.raises(ValueError, match="full pulls need batches"):
        load_new_files(spark, lake.spec(), lake.layout, SCHEMA)


def test_reading_the_bookmark_opens_one_file(spark, lake, monkeypatch):
    spec = appended(lake)
    log = lake.layout.bookmarks(spec, "wf")
    spark.range(1, 1001).select(F.col("id").cast("int"), F.current_timestamp().alias("landed_at"),
                                F.col("id").alias("n_rows"), F.lpad("id", 12, "0").alias("batch_id")
                                ).repartition(4).write.partitionBy("batch_id").parquet(log)
    mark = bookmark(spark, log, spark.createDataFrame([], "id int").schema.fields)
    assert [r.id for r in mark.collect()] == [1000] and len(mark.inputFiles()) == 1
    assert next_batch_id(spark, log) == "000000001001"
