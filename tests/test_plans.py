"""What the plans must look like for the operators to hold at scale."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import decode, lex_gt
from tidemark.operators import batch_keys, encode_partitions, key_range, matched_key_partitions, upsert
from tidemark.operators import merge as merge_module
from tidemark.operators.marks import high_water
from tidemark.sessions import adopt, planned_bytes, private_session, size_shuffles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """A session that never broadcasts and takes small partitions for skewed ones."""
    session = spark.newSession()
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }.items():
        session.conf.set(key, value)
    return session


@pytest.fixture
def hot(shuffled, tmp_path):
    """A table in which one key holds a third of the rows."""
    rows = shuffled.range(60000).repartition(6).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"), (F.col("id") % 5).cast("string").alias("p"))
    rows.write.parquet(str(tmp_path / "hot"))
    return shuffled.read.parquet(str(tmp_path / "hot"))


def staged_keys(batch, tmp_path):
    batch_keys(batch, ["k"], ["p"]).write.parquet(str(tmp_path / "keys"))
    return batch.sparkSession.read.parquet(str(tmp_path / "keys"))


def test_joins_split_a_hot_stored_key(hot, tmp_path):
    keys = staged_keys(hot.filter("k % 2 = 1"), tmp_path)
    merged = upsert(hot, hot.filter("k % 2 = 1"), ["k"], keys)
    assert len(merged.collect()) == 60000
    assert "SortMergeJoin(skew=true)" in plan(merged)
    matched = matched_key_partitions(hot, keys, ["k"], ["p"])
    assert len(matched.collect()) == hot.filter("k % 2 = 1").count()
    assert "SortMergeJoin(skew=true)" in plan(matched)


def test_keys_of_a_batch_are_reduced_before_their_shuffle(hot):
    text = plan(batch_keys(hot, ["k"], ["p"]))
    assert text.index("Exchange") < text.rindex("HashAggregate")  # printed from the top
    assert text.count("Exchange") == 1


def test_a_hot_partition_is_written_by_several_tasks(shuffled, hot, lake):
    spec = lake.mutable("p")
    shuffled.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500KB")
    skewed = hot.withColumn("p", F.when(F.col("k") % 2 == 1, "hot").otherwise(F.col("p")))
    from tidemark.plans.load import load_batch
    load_batch(skewed.withColumnRenamed("k", "id"), spec, lake.layout)
    files = [f.split("/")[0] for f in lake.files(spec)]
    cold = [f for f in files if f != "p=hot"]
    assert files.count("p=hot") > 1 and len(cold) == len(set(cold)) > 1


def test_small_key_lists_are_broadcast_and_large_ones_are_not(spark, hot, tmp_path):
    keys = staged_keys(hot.filter("k = 7"), tmp_path)
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    table, small = session.read.parquet(str(tmp_path / "hot")), session.read.parquet(str(tmp_path / "keys"))
    assert "BroadcastHashJoin" in plan(upsert(table, table.limit(0), ["k"], small))
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    assert "SortMergeJoin" in plan(upsert(table, table.limit(0), ["k"], small))


def test_the_range_of_the_keys_reaches_the_scan(spark, hot):
    bounds = key_range(batch_keys(hot.filter("k between 100 and 200"), ["k"]), ["k"])
    assert "PushedFilters: [IsNotNull(k), GreaterThanOrEqual(k," in plan(hot.filter(bounds).select("k"))


def test_a_bookmark_reaches_the_scan(spark, hot):
    kind = hot.schema["k"].dataType
    pulled = hot.filter(lex_gt(["k", "v"], [decode("59000", kind), F.lit("x")])).select("k")
    assert "GreaterThanOrEqual(k,59000)" in plan(pulled)


def test_a_water_mark_is_combined_before_its_exchange(hot):
    text = plan(high_water(hot, ["k", "v"]))
    assert text.count("Exchange SinglePartition") == 1 and "partial_max" in text


def test_adopted_rows_keep_their_plan_and_size(spark, hot):
    session = private_session(spark)
    adopted = adopt(session, hot)
    assert plan(adopted.filter("k > 5").select("k")).count("Scan") == 1
    assert "Union" not in plan(adopted) and "GreaterThan(k,5)" in plan(adopted.filter("k > 5"))
    assert planned_bytes(adopted) == planned_bytes(hot) < 1 << 30


def test_a_private_session_splits_skew_whatever_the_caller_has_set(spark):
    caller = spark.newSession()
    caller.conf.set("spark.sql.adaptive.enabled", "false")
    caller.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    caller.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    session = private_session(caller)
    assert session.conf.get("spark.sql.adaptive.enabled") == "true"
    assert session.conf.get("spark.sql.sources.partitionOverwriteMode") == "static"
    assert session.conf.get("spark.sql.session.timeZone") == "Asia/Kolkata"
    assert caller.conf.get("spark.sql.adaptive.enabled") == "false"


def test_a_task_of_a_private_session_sorts_and_scans_little(spark):
    session = private_session(spark)
    assert session.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "64MB"
    assert session.conf.get("spark.sql.files.maxPartitionBytes") == "32MB"
    caller = spark.newSession()
    caller.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200MB")
    assert private_session(caller).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "200MB"


def test_finding_the_folders_of_a_table_computes_nothing_for_each_row(spark, lake):
    spec = lake.mutable("p")
    lake.load(spec, spark.range(40).select("id", F.concat(F.lit("a b"), (F.col("id") % 3).cast("string")).alias("p")))
    table = lake.table(spec)
    text = plan(table._files(table.read()))
    assert "regexp" not in text and "ReadSchema: struct<>" in text
    assert sorted(table._folders(table.read())) == ["p=a b0", "p=a b1", "p=a b2"]


def test_shuffles_grow_with_the_input(spark):
    session = private_session(spark)
    for n_bytes, expected in ((0, "7"), (64 << 30, "1025"), (100 << 40, "1638401")):
        size_shuffles(session, "7", n_bytes)
        assert session.conf.get("spark.sql.shuffle.partitions") == expected


def test_a_list_of_partitions_prunes_without_a_join(spark, lake):
    spec = lake.mutable("p,q")
    rows = spark.range(40).select(F.col("id").cast("int"), (F.col("id") % 4).alias("p"), (F.col("id") % 5).alias("q"))
    lake.load(spec, rows)
    table = lake.table(spec).read()
    wanted = encode_partitions(table.filter("p < 3 and p = q"), ["p", "q"]).distinct().collect()
    found = merge_module.restrict_to_partitions(table, wanted, ["p", "q"])
    text = plan(found)
    assert "Join" not in text and "Exchange" not in text
    assert "p#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted({(r.p, r.q) for r in found.collect()}) == [(0, 0), (1, 1), (2, 2)]
