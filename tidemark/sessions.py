"""Sessions of our own: the caller's settings, plus those that a load relies on.

Adaptive execution is what splits a hot key or a hot partition, the overwrite
mode decides what a write deletes, and ANSI mode what becomes of values that do
not fit; none of them may depend on, or change, what the caller has set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Input bytes per shuffle partition (columnar files grow about threefold as
# shuffled rows), however many that makes: partitions that are all too large are
# not skewed, so adaptive execution would not split them. It merges small ones.
SHUFFLE_BYTES = 64 << 20
# Unless the caller has said: shuffled bytes that a task sorts for one output file (in memory
# about five times that), and file bytes that a task scans (rows for its shuffle, up to ten times that).
TASK_BYTES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB",
    "spark.sql.files.maxPartitionBytes": "32MB",
}
# Spark's "unknown" is around 8 EiB.
_UNKNOWN = 1 << 60

_REQUIRED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
    # Up to as many key values reach the statistics and Bloom filters of files one by one.
    "spark.sql.parquet.pushdown.inFilterThreshold": "256",
    # A value that does not fit the table's type must fail, not become NULL.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.storeAssignmentPolicy": "ANSI",
}


def private_session(spark: SparkSession) -> SparkSession:
    session = spark.newSession()
    for key, value in TASK_BYTES.items():
        session.conf.set(key, value)
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    for key, value in _REQUIRED.items():
        session.conf.set(key, value)
    return session


def adopt(session: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows, planned and run under the settings of `session`.

    A union belongs to the session of its first part; the optimizer removes the
    part that has no rows.
    """
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return session.range(1).filter(F.lit(False)).select(*columns).unionByName(df)


def planned_bytes(df: DataFrame) -> int | None:
    """What the optimizer expects to read, None if it cannot tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < _UNKNOWN else None


def size_shuffles(session: SparkSession, default: str, n_bytes: int) -> None:
    """As many shuffle partitions as the input needs, at least `default`."""
    needed = n_bytes // SHUFFLE_BYTES + 1
    session.conf.set("spark.sql.shuffle.partitions", str(max(int(default), needed)))
