"""What several operators share: words, saved tables, bucket counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.storage import working_folder

#: A word: a run of characters that are none of the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a table in the shared folder; cuts the lineage there."""
    path = working_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def bucket_count(n_rows: int) -> int:
    """Buckets of hash-random keys for a distributed rank or prefix sum.

    Both a bucket (500 rows or more) and the list of buckets stay near the
    square root of the rows, so neither pass over them meets a large group.
    """
    return max(1, math.ceil(n_rows / max(500, math.isqrt(n_rows))))


def bucket_of(hash64: Column, n_buckets: int) -> Column:
    """Order-preserving bucket of a 64-bit hash, by its leading 31 bits."""
    return F.shiftright(F.shiftrightunsigned(hash64, 33) * F.lit(n_buckets), 31)
