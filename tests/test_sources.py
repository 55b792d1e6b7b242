import json
import uuid

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.__main__ import main
from tidemark import JdbcSource, Layout, TableSpec, pull, pull_to_raw, run_file
from tidemark.sources import hash_bucket, hash_predicates, pull_table, spec_rows, validate_specs


@pytest.fixture(scope="module")
def database(spark):
    source = JdbcSource(f"jdbc:derby:memory:test_{uuid.uuid4().hex};create=true")
    rows = [(k, None if k % 11 == 0 else k % 3, f"name {k}") for k in range(-50, 50)]
    rows += [(1000 + k, 1, "hot") for k in range(300)]
    df = spark.createDataFrame(rows, "id bigint, grp int, name string")
    (df.write.option("createTableColumnTypes", "name VARCHAR(50)")
     .jdbc(source.url, "app.t", properties=source.properties))
    return source


def test_full_pull(spark, database):
    assert pull_table(spark, database, "app.t").count() == 400


@pytest.mark.parametrize("fields, buckets", [(["id"], 3), (["grp"], 4), (["GRP", "ID"], 3), (["id"], 1)])
def test_hash_predicates_cover_every_row_once(spark, database, fields, buckets):
    predicates = hash_predicates(spark, database, "app.t", fields, buckets)
    pulled = pull_table(spark, database, "app.t", predicates)
    assert pulled.rdd.getNumPartitions() == len(predicates) == buckets
    assert pulled.count() == pulled.select("id").distinct().count() == 400


def test_a_second_field_spreads_a_hot_value(spark, database):
    def largest(fields):
        predicates = hash_predicates(spark, database, "app.t", fields, 8)
        parts = pull_table(spark, database, "app.t", predicates).select("id")
        return parts.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    assert largest(["grp"]) > 300 and largest(["grp", "id"]) < 80


def test_text_columns_use_the_hash_of_the_database(database):
    my = JdbcSource("jdbc:mysql://host/db")
    pg = JdbcSource("jdbc:postgresql://host/db", {"user": "u"})
    assert hash_bucket(my, "n", T.StringType(), 3) == "COALESCE(ABS(MOD(CRC32(`n`), 3)), 0)"
    assert "hashtext" in hash_bucket(pg, "n", T.StringType(), 3)
    assert pg.properties["driver"] == "org.postgresql.Driver" and pg.properties["user"] == "u"
    with pytest.raises(ValueError, match="integer column"):
        hash_bucket(database, "n", T.StringType(), 3)
    with pytest.raises(ValueError):
        hash_bucket(my, "d", T.DoubleType(), 3)


def test_bookmark_and_buckets_are_both_pushed_into_the_database(spark, database, lake):
    spec = TableSpec("app", "t", lake.database, type_of_pull="incremental", nature_of_data="immutable",
                     bookmark_key="grp,id", bookmark_key_order="asc", parallel_pull="true",
                     hashfield="id", hashpartitions="3")
    everything = pull_table(spark, database, "app.t")
    pull_to_raw(spark, spec, lake.layout, "wf", everything.filter("grp < 1 or (grp = 1 and id <= 20)"))
    rest = pull(spark, spec, lake.layout, "wf", database)
    assert rest.rdd.getNumPartitions() == 3
    expected = everything.filter("grp > 1 or (grp = 1 and id > 20)").count()
    assert rest.count() == expected > 0
    plan = rest.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.split("Scan")[0], plan  # nothing is left to do after the scan
    assert "PushedFilters: [" in plan and "GRP" in plan.upper()


DOCUMENT = {"job_parameters": [
    {"source_raw_job_type": "python-shell", "type_of_pull": "incremental", "source_schema_name": "shop",
     "source_table_name": "orders", "nature_of_data": "mutable", "target_db_name": "lake-db",
     "target_partition_columns": "year, month", "compute_capacity_source_raw": "0.0625",
     "compute_capacity_raw_curated": "2", "raw_curated_worker_type": "G.1X",
     "bookmark_key": "changed_at", "bookmark_key_order": "asc", "source_db_type": "mysql",
     "primary_key": "order_id, line_id"},
    {"source_raw_job_type": "pyspark", "type_of_pull": "incremental", "source_schema_name": "shop",
     "source_table_name": "events", "nature_of_data": "immutable", "target_db_name": "lake-db",
     "target_partition_columns": "None", "compute_capacity_source_raw": 2,
     "compute_capacity_raw_curated": "2", "raw_curated_worker_type": "G.2X", "bookmark_key": "k1,k2",
     "bookmark_key_order": "desc", "parallel_pull": "true", "hashfield": "h", "hashpartitions": "3",
     "x_catalog_db_name": "src", "x_catalog_table_name": "shop_events"},
]}


def specs_of(spark, tmp_path, entries):
    path = tmp_path / "specs.json"
    path.write_text(json.dumps({"job_parameters": entries}, indent=2))
    return spec_rows(spark, str(path))


def test_a_clean_document(spark, tmp_path):
    rows = specs_of(spark, tmp_path, DOCUMENT["job_parameters"])
    assert validate_specs(rows).count() == 0
    orders, events = (TableSpec.from_row(r) for r in rows.collect())
    assert orders.primary_keys == ["order_id", "line_id"] and orders.partitions == ["year", "month"]
    assert not orders.is_parallel and orders.database == "lake_db"
    assert events.partitions == [] and events.is_parallel and events.hash_buckets == 3
    assert (events.catalog_db_name, events.catalog_table_name) == ("src", "shop_events")
    assert Layout("/x/").raw(events) == "/x/raw/shop/events"


def test_a_parameter_file_runs_from_end_to_end(spark, tmp_path, lake, database):
    entry = {**DOCUMENT["job_parameters"][1], "source_schema_name": "app", "source_table_name": "t",
             "target_db_name": lake.database, "bookmark_key": "id", "bookmark_key_order": "asc",
             "hashfield": "id"}
    path = tmp_path / "good.json"
    path.write_text(json.dumps({"job_parameters": [entry]}))
    for modes in (("create",), ()):
        result, = run_file(spark, str(path), lake.layout, "wf", database, str(tmp_path / "report"))
        assert (result.error, result.modes) == (None, modes)
    assert spark.table(f"{lake.database}.t").count() == 400
    path = tmp_path / "bad.json"
    path.write_text(json.dumps({"job_parameters": [entry, {**entry, "type_of_pull": "some"}]}))
    with pytest.raises(ValueError):
        run_file(spark, str(path), lake.layout, "wf", database, str(tmp_path / "report"))
    text = "".join(f.read_text() for f in (tmp_path / "report").glob("*.csv"))
    assert "app|t|type_of_pull must be one of: full, incremental" in text


def test_the_database_must_be_of_the_declared_kind(spark, lake, database):
    spec = lake.spec(source_db_type="mysql")
    with pytest.raises(ValueError, match="not in derby"):
        pull(spark, spec, lake.layout, "wf", database)
    assert JdbcSource.of("postgres", "h", 5432, "d", user="u").url == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError):
        JdbcSource.of("oracle", "h", 1, "d")


DEFECTS = [
    ({"source_raw_job_type": "bash"}, 0, 1), ({"type_of_pull": None}, 0, 1), ({"source_schema_name": " "}, 0, 1),
    ({"source_table_name": ""}, 0, 1), ({"nature_of_data": "x"}, 0, 1), ({"target_partition_columns": None}, 0, 1),
    ({"compute_capacity_source_raw": None}, 0, 1), ({"compute_capacity_raw_curated": "-1"}, 0, 1),
    ({"raw_curated_worker_type": "Huge"}, 0, 1), ({"source_db_type": "oracle"}, 0, 1),
    ({"bookmark_key": None}, 0, 1), ({"bookmark_key_order": "up"}, 0, 1), ({"primary_key": None}, 0, 1),
    ({"parallel_pull": None}, 1, 1), ({"x_catalog_db_name": None}, 1, 1), ({"x_catalog_table_name": " "}, 1, 1),
    ({"hashfield": None}, 1, 1), ({"hashpartitions": ""}, 1, 1),
    # A later rule that passes does not hide an earlier one that failed.
    ({"target_db_name": "  "}, 0, 1), ({"target_db_name": None, "primary_key": None}, 0, 2),
]


def test_every_defect_is_reported(spark, tmp_path):
    entries = []
    for number, (change, base, _) in enumerate(DEFECTS):
        entry = {**DOCUMENT["job_parameters"][base], **change, "compute_tag": str(number)}
        entries.append({k: v for k, v in entry.items() if v is not None})
    rows = specs_of(spark, tmp_path, entries)
    report = validate_specs(rows).collect()
    assert len(report) == len(DEFECTS)
    assert [r.Errors.count(" must ") + r.Errors.count(" needed ") for r in report] == [n for *_, n in DEFECTS]


@pytest.mark.parametrize("values", [
    {"source_schema_name": " "}, {"type_of_pull": "some"}, {"nature_of_data": "fluid"}, {"parallel_pull": "yes"},
    {"source_db_type": "oracle"}, {"type_of_pull": "incremental", "bookmark_key_order": "asc"},
    {"type_of_pull": "incremental", "bookmark_key": "a", "primary_key": "a"},
    {"type_of_pull": "incremental", "bookmark_key": "a", "bookmark_key_order": "asc"},
    {"parallel_pull": "true", "hashpartitions": "3"}, {"parallel_pull": "true", "hashfield": "a"},
    {"parallel_pull": "true", "hashfield": "a", "hashpartitions": "0"}, {"target_partition_columns": " "},
])
def test_contradicting_specs_fail_at_once(values):
    with pytest.raises(ValueError):
        TableSpec(**{"source_schema_name": "s", "source_table_name": "t", "target_db_name": "d", **values})


def test_a_broken_document_stops_the_run(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(DOCUMENT))
    for text in (json.dumps(DOCUMENT)[:-40], json.dumps({"other": 1})):
        (tmp_path / "other.json").write_text(text)
        with pytest.raises(Exception, match="MALFORMED|job_parameters"):
            spec_rows(spark, str(tmp_path)).collect()


def test_every_prefix_counts(spark, tmp_path):
    entry = {k: v for k, v in DOCUMENT["job_parameters"][1].items() if "catalog" not in k}
    a = {**entry, "a_catalog_db_name": "da", "a_catalog_table_name": "ta", "source_table_name": "one"}
    b = {**entry, "b_catalog_db_name": "db", "b_catalog_table_name": "tb", "source_table_name": "two"}
    rows = specs_of(spark, tmp_path, [a, b])
    assert validate_specs(rows).count() == 0
    assert [(r.catalog_db_name, r.catalog_table_name) for r in rows.collect()] == [("da", "ta"), ("db", "tb")]


@pytest.mark.parametrize("change, base", [
    ({"hashpartitions": "many"}, 1), ({"hashpartitions": "0"}, 1), ({"parallel_pull": "maybe"}, 0),
    ({"parallel_pull": "true"}, 0), ({"source_db_type": "oracle"}, 1)])
def test_what_a_run_would_refuse_is_reported(spark, tmp_path, change, base):
    row = specs_of(spark, tmp_path, [{**DOCUMENT["job_parameters"][base], **change}])
    with pytest.raises(ValueError):
        TableSpec.from_row(row.first())
    assert validate_specs(row).count() == 1


def test_specs_with_one_target_are_reported(spark, tmp_path):
    entry = DOCUMENT["job_parameters"][1]
    twins = [{**entry, "target_table_name": "x-y"}, {**entry, "source_table_name": "u", "target_table_name": "X_y"},
             {**entry, "source_table_name": "v"}]
    report = validate_specs(specs_of(spark, tmp_path, twins)).collect()
    assert sorted(r.source_table_name for r in report) == sorted([entry["source_table_name"], "u"])


def test_credentials_are_not_shown():
    assert "hidden" not in repr(JdbcSource.of("mysql", "h", 1, "d", password="hidden"))


def test_a_hot_hash_value_is_salted_by_an_integer_key(spark, database):
    rows = pull_table(spark, database, "app.t").schema
    text = next(f.name for f in rows if f.dataType.simpleString() == "string")
    salted = hash_predicates(spark, database, "app.t", ["id"], 4, [text])
    assert salted == hash_predicates(spark, database, "app.t", ["id"], 4)
    column = next((f.name for f in rows if f.name != "id" and "int" in f.dataType.simpleString()), None)
    if column:
        assert hash_predicates(spark, database, "app.t", [column], 4, ["id"]) == \
            hash_predicates(spark, database, "app.t", [column, "id"], 4)


def test_the_command_line(spark, tmp_path, lake, database, capsys, monkeypatch):
    entry = {**DOCUMENT["job_parameters"][1], "source_schema_name": "app", "source_table_name": "t",
             "target_db_name": lake.database, "bookmark_key": "id", "hashfield": "id"}
    missing = {**entry, "source_table_name": "no_such_table"}
    path = tmp_path / "tables.json"
    monkeypatch.setenv("DB_USER", "app")
    arguments = [str(path), lake.layout.root, "--workflow", "wf", "--url", database.url, "--option", "user=env:DB_USER"]
    for entries, code in (([entry], 0), ([entry, missing], 1), ([{**entry, "type_of_pull": ""}], 2)):
        path.write_text(json.dumps({"job_parameters": entries}))
        assert main(arguments) == code
    assert "app.t\tpulled 400\tloaded 400\tcreate\tok" in capsys.readouterr().out
