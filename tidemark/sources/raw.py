"""The raw layer: one parquet sub-folder per landed batch."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.columns import conform, fold
from tidemark.functions.lattice import common_schema
from tidemark.functions.literals import quote
from tidemark.storage import child_names, delete

BATCH = "batch_id"


def land(df: DataFrame, path: str, batch_id: str) -> DataFrame | None:
    """Write one batch and return what was landed, or None if it had no rows.

    The source is read exactly once: whether there were rows is asked of the
    landed files. Landing the same `batch_id` again replaces it, so a retry
    never doubles rows.
    """
    folder = f"{path}/{BATCH}={batch_id}"
    df.write.mode("overwrite").option("compression", "snappy").parquet(folder)
    landed = df.sparkSession.read.schema(df.schema).parquet(folder)
    if landed.isEmpty():
        delete(df.sparkSession, folder)
        return None
    return landed


def append_files(df: DataFrame, path: str) -> None:
    """Add files to a raw folder that has no batches (foreign producers)."""
    df.write.mode("append").option("compression", "snappy").parquet(path)


def raw_scan(spark: SparkSession, path: str) -> DataFrame:
    """Everything ever landed below `path`, with the columns of all files.

    Batches whose types differ are read by their own schemas and widened to the least
    common type; `ValueError` if there is none.
    """
    return _everything(spark, path).drop(BATCH)


def read_batches(spark: SparkSession, path: str, batch_ids: Sequence[str]) -> DataFrame:
    """The given batches only. No other folder is listed, no other footer read."""
    folders = [f"{path}/{BATCH}={batch_id}" for batch_id in batch_ids]
    return spark.read.option("mergeSchema", True).parquet(*folders)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches with their `batch_id`, kept as text."""
    found = _everything(spark, path)
    return found.select(*(F.col(quote(c)) for c in found.columns if c != BATCH), BATCH)


def _everything(spark: SparkSession, path: str) -> DataFrame:
    """All files below `path`, with their `batch_id` as text where they are in batches.

    Spark merges the schemas of all files in one distributed job. Only where their types
    contradict each other are they looked at one by one, and then each schema is one
    scan over all the batches (or plain files) that have it.
    """
    try:
        merged = spark.read.option("mergeSchema", True).parquet(path).schema
    except Exception as error:  # of the driver or, wrapped, of a task
        if "CANNOT_MERGE" not in str(error):
            raise
        return _widened(spark, path)
    if BATCH not in merged.names:
        return spark.read.schema(merged).parquet(path)
    fields = [f for f in merged.fields if f.name != BATCH]
    return spark.read.schema(T.StructType([*fields, T.StructField(BATCH, T.StringType())])).parquet(path)


def _widened(spark: SparkSession, path: str) -> DataFrame:
    names = sorted(n for n in child_names(spark, path) if not n.startswith((".", "_")))
    in_batches = all(n.startswith(f"{BATCH}=") for n in names)
    with ThreadPoolExecutor(max_workers=8) as pool:
        schemas = list(pool.map(lambda n: spark.read.parquet(f"{path}/{n}").schema, names))
    folded = partial(fold, spark)
    wanted = common_schema(schemas, folded)
    having: dict[str, list[str]] = {}
    for name, schema in zip(names, schemas):
        having.setdefault(schema.json(), []).append(name)
    parts = []
    for schema, of_schema in having.items():
        given = T.StructType.fromJson(json.loads(schema))
        known = {folded(f.name): f for f in given.fields}
        batch = [T.StructField(BATCH, T.StringType())] if in_batches else []
        rows = (spark.read.schema(T.StructType([*given.fields, *batch])).option("basePath", path)
                .parquet(*(f"{path}/{name}" for name in of_schema)))
        columns = [(conform(F.col(quote(known[folded(f.name)].name)), known[folded(f.name)].dataType, f.dataType,
                            f.name, folded) if folded(f.name) in known else F.lit(None).cast(f.dataType)).alias(f.name)
                   for f in wanted.fields]
        parts.append(rows.select(*columns, *(f.name for f in batch)))
    return reduce(DataFrame.unionAll, parts)


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows per batch; reads footers and folder names, no column."""
    ids = spark.read.schema(f"{BATCH} string").parquet(path)
    return ids.groupBy(BATCH).agg(F.count(F.lit(1)).alias("n"))
