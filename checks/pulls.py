"""Incremental pulls, bookmarks, relational pulls, raw landing and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.curated import BY_STATUS, KEY, MERGED
from checks.lake import WORKFLOW, Lake, order_changes, read, relational
from tidemark.operators.counts import row_counts as count_rows
from tidemark.operators.marks import high_water, low_water
from tidemark.plans.bookmarks import bookmark_state as saved_state
from tidemark.plans.chain import pull, pull_to_raw, run_all, run_table
from tidemark.sources.jdbc import hash_predicates, pull_table, range_predicates
from tidemark.sources.raw import append_files, batch_counts, land, raw_scan as scan_raw
from tidemark.spec import TableSpec
from tidemark.storage import delete
from tidemark.streaming.new_files import load_logged_batches, load_new_files

MID_MONTH = "timestamp_ntz'2024-01-15 00:00:00'"
NEW_YEAR = "timestamp_ntz'1998-01-01 00:00:00'"


def _incremental(lake: Lake, table: str, keys: str, order: str = "asc", **values: str) -> TableSpec:
    return lake.spec(table, type_of_pull="incremental", nature_of_data="immutable",
                     bookmark_key=keys, bookmark_key_order=order, **values)


def _second_pull(lake: Lake, spec: TableSpec, first: DataFrame, source) -> DataFrame:
    """What is pulled after a run that saw only `first`."""
    pull_to_raw(lake.spark, spec, lake.layout, WORKFLOW, first)
    return pull(lake.spark, spec, lake.layout, WORKFLOW, source)


def incremental_first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    return pull(spark, _incremental(lake, "events", "ts"), lake.layout, WORKFLOW, lake.table("events"))


def incremental_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    events = lake.table("events")
    return _second_pull(lake, _incremental(lake, "events", "ts"), events.filter(f"ts <= {MID_MONTH}"), events)


def incremental_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = _incremental(lake, "orders", "o_orderdate", "desc")
    return _second_pull(lake, spec, orders.filter(f"o_orderdate >= {NEW_YEAR}"), orders)


def _composite(spark: SparkSession, sf_dir: str, order: str) -> DataFrame:
    """The first run ends in the middle of a tie on the first key."""
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = _incremental(lake, "orders", "o_orderpriority, o_orderkey", order)
    priority, key = F.col("o_orderpriority"), F.col("o_orderkey")
    middle = orders.agg(F.avg("o_orderkey")).scalar()
    before, tie = ((priority < "3-MEDIUM", key <= middle) if order == "asc"
                   else (priority > "3-MEDIUM", key >= middle))
    first = orders.filter(before | ((priority == "3-MEDIUM") & tie))
    return _second_pull(lake, spec, first, orders)


def incremental_composite_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir, "asc")


def incremental_composite_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir, "desc")


def incremental_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole runs: half the month, then everything; nothing lost or doubled."""
    lake = Lake(spark, sf_dir)
    events = lake.table("events")
    spec = _incremental(lake, "events", "ts,event_id")
    run_table(spark, spec, lake.layout, WORKFLOW, events.filter(f"ts <= {MID_MONTH}"))
    run_table(spark, spec, lake.layout, WORKFLOW, events)
    return lake.rows(spec, events)


def incremental_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    source = relational(spark, sf_dir, "orders")
    spec = TableSpec(source_schema_name="app", source_table_name="orders", target_db_name=lake.database,
                     type_of_pull="incremental", nature_of_data="immutable",
                     bookmark_key="o_orderdate,o_orderkey", bookmark_key_order="asc",
                     parallel_pull="true", hashfield="o_custkey,o_orderkey", hashpartitions="4")
    return _second_pull(lake, spec, orders.filter(f"o_orderdate <= {NEW_YEAR}"), source)


def high_water_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_water(read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])


def low_water_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return low_water(read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])


def bookmark_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = _incremental(lake, "orders", "o_orderdate,o_orderkey")
    pull_to_raw(spark, spec, lake.layout, WORKFLOW, orders.filter(f"o_orderdate <= {NEW_YEAR}"))
    pull_to_raw(spark, spec, lake.layout, WORKFLOW, orders)
    fields = [orders.schema[k] for k in spec.bookmark_keys]
    return saved_state(spark, lake.layout.bookmarks(spec, WORKFLOW), fields, WORKFLOW, "main", "orders")


def jdbc_full_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pull_table(spark, relational(spark, sf_dir, "customer"), "app.customer")


def jdbc_hash_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = relational(spark, sf_dir, "orders")
    predicates = hash_predicates(spark, source, "app.orders", ["o_custkey", "o_orderkey"], 4)
    return pull_table(spark, source, "app.orders", predicates)


def jdbc_range_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of about equal counts by a key that has many rows for each value."""
    source = relational(spark, sf_dir, "orders")
    predicates = range_predicates(spark, source, "app.orders", "o_custkey", 4)
    return pull_table(spark, source, "app.orders", predicates)


def hash_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each of three connections pulls."""
    source = relational(spark, sf_dir, "orders")
    predicates = hash_predicates(spark, source, "app.orders", ["o_orderkey"], 3)
    pulled = pull_table(spark, source, "app.orders", predicates).select("o_orderkey")
    by_connection = pulled.groupBy(F.spark_partition_id().cast("bigint").alias("bucket"))
    return by_connection.agg(F.count(F.lit(1)).alias("n"))


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the second with a column the first lacks; read back as one."""
    lake = Lake(spark, sf_dir)
    items = lake.table("lineitem")
    path = lake.layout.raw(lake.spec("lineitem"))
    land(items.filter("l_linestatus = 'O'"), path, "000000000001")
    land(items.filter("l_linestatus <> 'O'").withColumn("channel", F.lit("web")), path, "000000000002")
    return scan_raw(spark, path).select(*items.columns, "channel")


def raw_scan_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose types have drifted, at the top and inside a struct, read back as one."""
    lake = Lake(spark, sf_dir)
    items = lake.table("lineitem")
    path = lake.layout.raw(lake.spec("lineitem"))
    old = items.filter("l_linestatus = 'O'").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("int"), F.col("l_quantity").cast("int"),
        F.struct(F.col("l_suppkey").cast("int").alias("supplier"), "l_returnflag").alias("detail"))
    new = items.filter("l_linestatus <> 'O'").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        F.struct("l_tax", F.col("l_suppkey").alias("Supplier")).alias("detail"))
    land(old, path, "000000000001")
    land(new, path, "000000000002")
    return scan_raw(spark, path).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "detail.*")


def raw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per landed batch; the second batch is landed twice, as by a retry."""
    lake = Lake(spark, sf_dir)
    events = lake.table("events")
    path = lake.layout.raw(lake.spec("events"))
    land(events.filter(f"ts <= {MID_MONTH}"), path, "20240115000000")
    for _ in range(2):
        land(events.filter(f"ts > {MID_MONTH}"), path, "20240131000000")
    return batch_counts(spark, path)


def stream_new_files_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files appear between runs; the third run finds nothing new."""
    lake = Lake(spark, sf_dir)
    events = lake.table("events")
    spec = _incremental(lake, "events", "ts")
    path = lake.layout.raw(spec)
    append_files(events.filter(f"ts <= {MID_MONTH}"), path)
    load_new_files(spark, spec, lake.layout, events.schema)
    append_files(events.filter(f"ts > {MID_MONTH}"), path)
    load_new_files(spark, spec, lake.layout, events.schema)
    load_new_files(spark, spec, lake.layout, events.schema)
    return lake.rows(spec, events)


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY, **BY_STATUS)
    for batch in (orders, order_changes(orders)):
        append_files(batch, lake.layout.raw(spec))
        load_new_files(spark, spec, lake.layout, orders.schema)
    return lake.rows(spec, orders)


def append_after_lost_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs; in between, the stream forgets what it has loaded."""
    lake = Lake(spark, sf_dir)
    events = lake.table("events")
    spec = _incremental(lake, "events", "ts,event_id")
    run_table(spark, spec, lake.layout, WORKFLOW, events.filter(f"ts <= {MID_MONTH}"))
    delete(spark, lake.layout.checkpoint(spec, WORKFLOW))
    run_table(spark, spec, lake.layout, WORKFLOW, events)
    return lake.rows(spec, events)


def two_workflows_one_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workflows land a half each before either loads."""
    lake = Lake(spark, sf_dir)
    events = lake.table("events")
    spec = _incremental(lake, "events", "ts,event_id")
    pull_to_raw(spark, spec, lake.layout, "w1", events.filter(f"ts <= {MID_MONTH}"))
    pull_to_raw(spark, spec, lake.layout, "w2", events.filter(f"ts > {MID_MONTH}"))
    for workflow in ("w1", "w2"):
        load_logged_batches(spark, spec, lake.layout, workflow)
    return lake.rows(spec, events)


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows({name: read(spark, sf_dir, name) for name in ("orders", "events", "lineitem")})


def chain_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over two tables, with landing, bookmarks and loads: orders are
    merged, events appended."""
    lake = Lake(spark, sf_dir)
    orders, events = lake.table("orders"), lake.table("events")
    # A source keeps a version number per row; it is the bookmark.
    first = orders.withColumn("version", F.lit(1))
    second = first.unionByName(order_changes(orders).withColumn("version", F.lit(2)))
    specs = [
        lake.spec("orders", **{**KEY, "bookmark_key": "version"}, **BY_STATUS),
        _incremental(lake, "events", "ts,event_id"),
    ]
    runs = [
        {"main.orders": first, "main.events": events.filter(f"ts <= {MID_MONTH}")},
        {"main.orders": second, "main.events": events},
    ]
    for sources in runs:
        failed = [r for r in run_all(spark, specs, lake.layout, WORKFLOW, sources) if r.error]
        if failed:
            raise RuntimeError(f"{failed[0].source}: {failed[0].error}")
    return count_rows({spec.source_table_name: lake.rows(spec) for spec in specs})


QUERIES = {
    "append_after_lost_checkpoint": append_after_lost_checkpoint,
    "two_workflows_one_source": two_workflows_one_source,
    "incremental_first_run": incremental_first_run,
    "incremental_asc": incremental_asc,
    "incremental_desc": incremental_desc,
    "incremental_composite_asc": incremental_composite_asc,
    "incremental_composite_desc": incremental_composite_desc,
    "incremental_two_runs": incremental_two_runs,
    "incremental_parallel": incremental_parallel,
    "high_water_asc": high_water_asc,
    "low_water_desc": low_water_desc,
    "bookmark_state": bookmark_state,
    "jdbc_full_pull": jdbc_full_pull,
    "jdbc_hash_pull": jdbc_hash_pull,
    "jdbc_range_pull": jdbc_range_pull,
    "hash_bucket_counts": hash_bucket_counts,
    "raw_scan": raw_scan,
    "raw_scan_widened": raw_scan_widened,
    "raw_batches": raw_batches,
    "stream_new_files_once": stream_new_files_once,
    "stream_merge": stream_merge,
    "row_counts": row_counts,
    "chain_two_tables": chain_two_tables,
}

_MIDDLE = "(SELECT avg(o_orderkey) FROM orders)"
_MARK_ASC = f"""(SELECT o_orderpriority, o_orderkey FROM orders
  WHERE o_orderpriority < '3-MEDIUM' OR (o_orderpriority = '3-MEDIUM' AND o_orderkey <= {_MIDDLE})
  ORDER BY 1 DESC, 2 DESC LIMIT 1)"""
_MARK_DESC = f"""(SELECT o_orderpriority, o_orderkey FROM orders
  WHERE o_orderpriority > '3-MEDIUM' OR (o_orderpriority = '3-MEDIUM' AND o_orderkey >= {_MIDDLE})
  ORDER BY 1, 2 LIMIT 1)"""

SQL = {
    "append_after_lost_checkpoint": "SELECT * FROM events",
    "two_workflows_one_source": "SELECT * FROM events",
    "incremental_first_run": "SELECT * FROM events",
    "incremental_asc": """SELECT * FROM events
WHERE ts > (SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00')""",
    "incremental_desc": """SELECT * FROM orders
WHERE o_orderdate < (SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00')""",
    "incremental_composite_asc": f"""SELECT o.* FROM orders o, {_MARK_ASC} m
WHERE o.o_orderpriority > m.o_orderpriority
   OR (o.o_orderpriority = m.o_orderpriority AND o.o_orderkey > m.o_orderkey)""",
    "incremental_composite_desc": f"""SELECT o.* FROM orders o, {_MARK_DESC} m
WHERE o.o_orderpriority < m.o_orderpriority
   OR (o.o_orderpriority = m.o_orderpriority AND o.o_orderkey < m.o_orderkey)""",
    "incremental_two_runs": "SELECT * FROM events",
    "incremental_parallel": """SELECT o.* FROM orders o,
  (SELECT o_orderdate, o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01 00:00:00'
   ORDER BY 1 DESC, 2 DESC LIMIT 1) m
WHERE o.o_orderdate > m.o_orderdate
   OR (o.o_orderdate = m.o_orderdate AND o.o_orderkey > m.o_orderkey)""",
    "high_water_asc": "SELECT o_orderdate, o_orderkey FROM orders ORDER BY 1 DESC, 2 DESC LIMIT 1",
    "low_water_desc": "SELECT o_orderdate, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 1",
    "bookmark_state": """SELECT 'wf|main|orders' AS identifier, o_orderdate, o_orderkey
FROM orders ORDER BY 2 DESC, 3 DESC LIMIT 1""",
    "jdbc_full_pull": "SELECT * FROM customer",
    "jdbc_hash_pull": "SELECT * FROM orders",
    "jdbc_range_pull": "SELECT * FROM orders",
    "hash_bucket_counts": "SELECT o_orderkey % 3 AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "raw_scan": """SELECT *, CASE WHEN l_linestatus <> 'O' THEN 'web' END AS channel FROM lineitem""",
    "raw_scan_widened": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_suppkey AS supplier,
  CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS l_returnflag,
  CASE WHEN l_linestatus <> 'O' THEN l_tax END AS l_tax FROM lineitem""",
    "raw_batches": """SELECT CASE WHEN ts <= TIMESTAMP '2024-01-15 00:00:00' THEN '20240115000000'
  ELSE '20240131000000' END AS batch_id, count(*) AS n FROM events GROUP BY 1""",
    "stream_new_files_once": "SELECT * FROM events",
    "stream_merge": f"WITH {MERGED} SELECT * FROM merged",
    "row_counts": """SELECT 'orders' AS table_name, count(*) AS n FROM orders
UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'lineitem', count(*) FROM lineitem""",
    "chain_two_tables": f"""WITH {MERGED}
SELECT 'orders' AS table_name, count(*) AS n FROM merged
UNION ALL SELECT 'events', count(*) FROM events""",
}
