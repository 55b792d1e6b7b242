"""First load, append, replace, merge and purge of curated tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.lake import Lake, order_changes
from tidemark.operators.latest import latest_by
from tidemark.operators.merge import (
    affected_partitions, batch_keys, encode_partitions, matched_key_partitions,
    restrict_to_partitions,
)
from tidemark.plans.load import load_batch

KEY = {"type_of_pull": "incremental", "bookmark_key": "o_orderkey", "bookmark_key_order": "asc",
       "primary_key": "o_orderkey"}
BY_STATUS = {"target_partition_columns": "o_orderstatus"}
BY_STATUS_AND_PRIORITY = {"target_partition_columns": "o_orderstatus, o_orderpriority"}
IMMUTABLE = {"nature_of_data": "immutable"}

CHANGES = """
  changes AS (
    SELECT o_orderkey, o_custkey, 'F' AS o_orderstatus, o_totalprice + 1 AS o_totalprice,
           o_orderdate, o_orderpriority
    FROM orders WHERE o_orderstatus = 'P'
    UNION ALL
    SELECT -1 - o_orderkey, o_custkey, 'O', o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderpriority = '1-URGENT')"""
MERGED = f"""{CHANGES},
  merged AS (
    SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)
    UNION ALL
    SELECT * FROM changes)"""


def _merged_orders(spark: SparkSession, sf_dir: str, **spec_values: str) -> tuple[Lake, object, DataFrame]:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY, **spec_values)
    lake.load(spec, orders, "1")
    lake.load(spec, order_changes(orders), "2")
    return lake, spec, orders


def merge_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, spec, orders = _merged_orders(spark, sf_dir, **BY_STATUS)
    return lake.rows(spec, orders)


def merge_two_partition_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, spec, orders = _merged_orders(spark, sf_dir, **BY_STATUS_AND_PRIORITY)
    return lake.rows(spec, orders)


def merge_new_struct_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch brings a field that a struct of the table lacks; stored rows read NULL in it."""
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY, **BY_STATUS)
    lake.load(spec, orders.withColumn("detail", F.struct("o_orderpriority")), "1")
    lake.load(spec, order_changes(orders).withColumn("detail", F.struct("o_totalprice", "o_orderpriority")), "2")
    return lake.rows(spec).select("o_orderkey", "o_orderstatus", F.col("detail.o_orderpriority").alias("priority"),
                                  F.col("detail.o_totalprice").alias("price"))


def merge_latest_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with one row per user, kept at the user's last event: every batch has many events of a user."""
    lake = Lake(spark, sf_dir)
    events = lake.table("events")
    spec = lake.spec("events", type_of_pull="incremental", bookmark_key="ts,event_id", bookmark_key_order="asc",
                     primary_key="user_id", target_partition_columns="event_type")
    middle = "timestamp_ntz'2024-01-15 00:00:00'"
    for batch_id, batch in (("1", events.filter(f"ts <= {middle}")), ("2", events.filter(f"ts > {middle}"))):
        lake.load(spec, latest_by(batch, spec.primary_keys, spec.bookmark_keys), batch_id)
    return lake.rows(spec, events)


def merge_unpartitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, spec, orders = _merged_orders(spark, sf_dir)
    return lake.rows(spec, orders)


def merge_moved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, spec, _ = _merged_orders(spark, sf_dir, **BY_STATUS)
    return lake.rows(spec).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def merge_null_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    status = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderstatus"))
    spec = lake.spec("orders", **KEY, **BY_STATUS)
    lake.load(spec, orders.withColumn("o_orderstatus", status), "1")
    lake.load(spec, order_changes(orders).withColumn("o_orderstatus", status), "2")
    return lake.rows(spec, orders)


def merge_key_in_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partition column is part of the key, so rows cannot move."""
    lake = Lake(spark, sf_dir)
    turns = lake.table("conversations")
    spec = lake.spec("conversations", type_of_pull="incremental", bookmark_key="conv_id",
                     bookmark_key_order="asc", primary_key="conv_id,turn,role",
                     target_partition_columns="role")
    lake.load(spec, turns, "1")
    edited = turns.filter("role = 'assistant'").withColumn("text", F.concat("text", F.lit(" [edited]")))
    lake.load(spec, edited, "2")
    return lake.rows(spec, turns)


def merge_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    turns = lake.table("conversations")
    spec = lake.spec("conversations", type_of_pull="incremental", bookmark_key="conv_id,turn",
                     bookmark_key_order="asc", primary_key="conv_id, turn")
    lake.load(spec, turns, "1")
    edited = turns.filter("role = 'assistant'").withColumn("text", F.concat("text", F.lit(" [edited]")))
    lake.load(spec, edited, "2")
    return lake.rows(spec, turns)


def merge_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is not unique, neither in the table nor in the batch."""
    lake = Lake(spark, sf_dir)
    items = lake.table("lineitem")
    spec = lake.spec("lineitem", type_of_pull="incremental", bookmark_key="l_orderkey",
                     bookmark_key_order="asc", primary_key="l_orderkey,l_linenumber",
                     target_partition_columns="l_linestatus")
    lake.load(spec, items, "1")
    lake.load(spec, items.filter("l_returnflag = 'R'").withColumn("l_tax", F.lit(0.0)), "2")
    return lake.rows(spec, items)


def merge_many_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of affected combinations: order month, priority and status."""
    lake = Lake(spark, sf_dir)
    month = F.date_format("o_orderdate", "yyyy-MM")
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY, target_partition_columns="month, o_orderpriority, o_orderstatus")
    lake.load(spec, orders.withColumn("month", month), "1")
    lake.load(spec, order_changes(orders).withColumn("month", month), "2")
    return lake.rows(spec, orders)


def merge_struct_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch has a struct's fields, and those of structs in an array, in another order."""
    lake = Lake(spark, sf_dir)
    events = lake.table("events")
    spec = lake.spec("events", type_of_pull="incremental", bookmark_key="event_id", bookmark_key_order="asc",
                     primary_key="event_id")

    def nested(rows: DataFrame, *order: str) -> DataFrame:
        one = F.struct(*order)
        return rows.select("event_id", one.alias("one"), F.array(one).alias("many"))

    lake.load(spec, nested(events, "user_id", "event_type", "value"), "1")
    clicks = events.filter("event_type = 'click'").withColumn("value", F.col("value") + 1)
    lake.load(spec, nested(clicks, "value", "user_id", "event_type"), "2")
    return lake.rows(spec).select("event_id", "one.user_id", "one.event_type", "one.value",
                                  F.col("many")[0]["value"].alias("value_in_array"))


def replace_failure_keeps_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full pull with one key that does not fit fails, and leaves both layouts as they are."""
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    small = orders.withColumn("o_custkey", F.col("o_custkey").cast("int"))
    kept = []
    for name, layout in (("plain", {}), ("parted", BY_STATUS)):
        spec = lake.spec("orders", target_table_name=name, **layout)
        spec = replace(spec, source_table_name=name)
        lake.load(spec, small, "1")
        wide = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") == 0, 1 << 40).otherwise(F.col("o_custkey")))
        try:
            lake.load(spec, wide, "2")
        except Exception as error:
            if "CAST_OVERFLOW" not in str(error):
                raise
        else:
            raise AssertionError("a value that does not fit was stored")
        kept.append(lake.rows(spec, orders).withColumn("layout", F.lit(name)))
    return kept[0].unionByName(kept[1])


def merge_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY, **BY_STATUS)
    lake.load(spec, orders, "1")
    batch = order_changes(orders).withColumn("channel", F.lit("web"))
    lake.load(spec, batch, "2")
    return lake.rows(spec, batch)


def merge_nested_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays survive landing and merging; reported element by element."""
    lake = Lake(spark, sf_dir)
    vectors = lake.table("embeddings")
    spec = lake.spec("embeddings", type_of_pull="incremental", bookmark_key="vec_id",
                     bookmark_key_order="asc", primary_key="vec_id", target_partition_columns="label")
    lake.load(spec, vectors, "1")
    lake.load(spec, vectors.withColumn("embedding", F.reverse("embedding")), "2")
    return lake.rows(spec, vectors).select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")) \
        .select("vec_id", "label", "pos", F.col("x").cast("double").alias("x"))


def append_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **{**KEY, **IMMUTABLE}, **BY_STATUS)
    lake.load(spec, orders, "1")
    batch = order_changes(orders).withColumn("channel", F.lit("web"))
    lake.load(spec, batch, "2")
    return lake.rows(spec, batch)


def matched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY, **BY_STATUS)
    lake.load(spec, orders, "1")
    keys = batch_keys(order_changes(orders), spec.primary_keys)
    return matched_key_partitions(lake.rows(spec), keys, spec.primary_keys, spec.partitions)


def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY, **BY_STATUS)
    lake.load(spec, orders, "1")
    keys = batch_keys(order_changes(orders), spec.primary_keys, spec.partitions)
    rows = affected_partitions(lake.rows(spec), keys, spec.primary_keys, spec.partitions)
    return rows.select("o_orderstatus", "in_batch")


def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read only the partitions that the batch has rows for."""
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY, **BY_STATUS)
    lake.load(spec, orders, "1")
    wanted = encode_partitions(order_changes(orders).select(*spec.partitions).distinct(), spec.partitions)
    return restrict_to_partitions(lake.rows(spec, orders), wanted.collect(), spec.partitions)


def purge_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY, **BY_STATUS_AND_PRIORITY)
    lake.load(spec, orders, "1")
    lake.curated(spec).purge(F.col("o_orderstatus") == "F")
    return lake.rows(spec, orders)


def first_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY, **BY_STATUS)
    lake.load(spec, orders, "1")
    return lake.rows(spec, orders)


def first_unpartitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **KEY)
    lake.load(spec, orders, "1")
    return lake.rows(spec, orders)


def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, in two partition columns."""
    lake = Lake(spark, sf_dir)
    documents = lake.table("documents")
    spec = lake.spec("documents", target_partition_columns="lang,source")
    lake.load(spec, documents, "1")
    return lake.rows(spec, documents)


def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **{**KEY, **IMMUTABLE}, **BY_STATUS)
    lake.load(spec, orders, "1")
    lake.load(spec, order_changes(orders), "2")
    return lake.rows(spec, orders)


def _replaced(spark: SparkSession, sf_dir: str, **spec_values: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **spec_values)
    lake.load(spec, orders, "1")
    lake.load(spec, orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)
              .withColumn("o_orderstatus", F.lit("F")), "2")
    return lake.rows(spec, orders)


def replace_immutable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir, **IMMUTABLE, **BY_STATUS)


def replace_mutable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir, **BY_STATUS_AND_PRIORITY)


def empty_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = Lake(spark, sf_dir)
    orders = lake.table("orders")
    spec = lake.spec("orders", **BY_STATUS)
    lake.load(spec, orders, "1")
    load_batch(orders.filter(F.lit(False)), spec, lake.layout, load_id="2")
    return lake.rows(spec, orders)


QUERIES = {
    "merge_many_partitions": merge_many_partitions,
    "merge_struct_by_name": merge_struct_by_name,
    "replace_failure_keeps_rows": replace_failure_keeps_rows,
    "merge_partitioned": merge_partitioned,
    "merge_two_partition_columns": merge_two_partition_columns,
    "merge_unpartitioned": merge_unpartitioned,
    "merge_moved_rows": merge_moved_rows,
    "merge_new_struct_field": merge_new_struct_field,
    "merge_latest_by": merge_latest_by,
    "merge_null_partition": merge_null_partition,
    "merge_key_in_partition": merge_key_in_partition,
    "merge_composite_key": merge_composite_key,
    "merge_duplicate_keys": merge_duplicate_keys,
    "merge_new_column": merge_new_column,
    "merge_nested_columns": merge_nested_columns,
    "append_new_column": append_new_column,
    "matched_key_partitions": matched_keys,
    "affected_partitions": affected,
    "pruned_scan": pruned_scan,
    "purge_partitions": purge_partitions,
    "curated_first_partitioned": first_partitioned,
    "curated_first_unpartitioned": first_unpartitioned,
    "curated_first_documents": first_documents,
    "curated_append": append,
    "curated_replace_immutable": replace_immutable,
    "curated_replace_mutable": replace_mutable,
    "empty_batch_noop": empty_batch,
}

_EDITED = """SELECT conv_id, turn, role,
  CASE WHEN role = 'assistant' THEN text || ' [edited]' ELSE text END AS text
FROM conversations"""
_REPLACED = "SELECT * REPLACE (o_totalprice + 1 AS o_totalprice, 'F' AS o_orderstatus) FROM orders"

SQL = {
    "merge_many_partitions": f"WITH {MERGED} SELECT * FROM merged",
    "merge_struct_by_name": """SELECT event_id, user_id, event_type, value, value AS value_in_array FROM (
  SELECT event_id, user_id, event_type, CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS value
  FROM events)""",
    "replace_failure_keeps_rows": """SELECT * REPLACE (o_custkey::INTEGER AS o_custkey)
FROM orders, (VALUES ('plain'), ('parted')) AS t (layout)""",
    "merge_partitioned": f"WITH {MERGED} SELECT * FROM merged",
    "merge_two_partition_columns": f"WITH {MERGED} SELECT * FROM merged",
    "merge_unpartitioned": f"WITH {MERGED} SELECT * FROM merged",
    "merge_new_struct_field": f"""WITH {MERGED}
SELECT o_orderkey, o_orderstatus, o_orderpriority AS priority,
  CASE WHEN o_orderkey IN (SELECT o_orderkey FROM changes) THEN o_totalprice END AS price FROM merged""",
    "merge_latest_by": """SELECT * FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "merge_moved_rows": f"WITH {MERGED} SELECT o_orderstatus, count(*) AS n FROM merged GROUP BY o_orderstatus",
    "merge_null_partition": f"""WITH {MERGED}
SELECT * REPLACE (CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderstatus END AS o_orderstatus)
FROM merged""",
    "merge_key_in_partition": _EDITED,
    "merge_composite_key": _EDITED,
    "merge_duplicate_keys": """SELECT * FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R'
                  AND r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber)
UNION ALL
SELECT * REPLACE (0.0::DOUBLE AS l_tax) FROM lineitem WHERE l_returnflag = 'R'""",
    "merge_new_column": f"""WITH {CHANGES}
SELECT *, NULL::VARCHAR AS channel FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)
UNION ALL
SELECT *, 'web' AS channel FROM changes""",
    "merge_nested_columns": """SELECT vec_id, label, pos::INTEGER AS pos,
  embedding[len(embedding) - pos]::DOUBLE AS x
FROM embeddings, unnest(range(len(embedding))) AS t(pos)""",
    "append_new_column": f"""WITH {CHANGES}
SELECT *, NULL::VARCHAR AS channel FROM orders
UNION ALL
SELECT *, 'web' AS channel FROM changes""",
    "matched_key_partitions": f"""WITH {CHANGES}
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM changes)""",
    "affected_partitions": f"""WITH {CHANGES}
SELECT o_orderstatus, o_orderstatus IN (SELECT o_orderstatus FROM changes) AS in_batch
FROM (SELECT o_orderstatus FROM changes
      UNION
      SELECT o_orderstatus FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM changes))""",
    "pruned_scan": f"""WITH {CHANGES}
SELECT * FROM orders WHERE o_orderstatus IN (SELECT o_orderstatus FROM changes)""",
    "purge_partitions": "SELECT * FROM orders WHERE o_orderstatus <> 'F'",
    "curated_first_partitioned": "SELECT * FROM orders",
    "curated_first_unpartitioned": "SELECT * FROM orders",
    "curated_first_documents": "SELECT * FROM documents",
    "curated_append": f"WITH {CHANGES} SELECT * FROM orders UNION ALL SELECT * FROM changes",
    "curated_replace_immutable": _REPLACED,
    "curated_replace_mutable": _REPLACED,
    "empty_batch_noop": "SELECT * FROM orders",
}
