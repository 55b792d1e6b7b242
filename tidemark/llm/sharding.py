"""Proportional stratified interleaving into shards, law `rows`.

Rows are shuffled by a seeded hash and ranked within their source; the rank as a
fraction of the source's rows, from a start that differs by source, is a place
on a common line. Cutting that line into equal counts gives every shard each
source in proportion, to within about one row.

Both ranks are distributed: counts of buckets first, then rows within a bucket,
so a source with a third of all rows is never in one task.

Defined cases: a NULL text has 0 bytes and checksum 0; a NULL source is a source
of its own; repeated rows are placed one by one, in any order among themselves;
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import bucket_count, bucket_of, saved


def _fraction_bits(n_digits: int, *parts: Column) -> Column:
    """The leading hexadecimal digits of the parts' md5 as a number."""
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, n_digits), 16, 10).cast("long")


def stratified_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text: str = "text",
                      source: str = "source", seed: int = 42) -> DataFrame:
    """id, source, size, text_crc32, shard, slot: counts of shards differ by one at most."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = saved(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("~")).alias("source_key"),
        (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"),
        _fraction_bits(15, F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit(":"),
                       F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("~"))).alias("key")), "shards")
    n = rows.count()
    n_buckets = bucket_count(n)

    rows = rows.withColumn("bucket", bucket_of(F.shiftleft("key", 4), n_buckets))
    counts = rows.groupBy("source_key", "bucket").agg(F.count("*").alias("n"))
    of_source = Window.partitionBy("source_key")
    earlier = of_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"),
                           F.sum("n").over(of_source).alias("of"))
    # The leading bits give the bucket, so the order of buckets is that of the keys.
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy("key", "id", "size", "text_crc32")
    rank = F.col("start") + F.row_number().over(in_bucket) - 1
    offset = _fraction_bits(13, F.lit(f"{seed}:"), F.col("source_key")) / F.lit(float(1 << 52))
    placed = (rows.join(starts, ["source_key", "bucket"])
              .withColumn("place", (rank + offset) / F.col("of"))
              .withColumn("stretch", F.least(F.floor(F.col("place") * n_buckets), F.lit(n_buckets - 1)))
              .drop("bucket", "start", "of"))
    placed = saved(placed, "places")

    counts = placed.groupBy("stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy().orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    in_stretch = Window.partitionBy("stretch").orderBy("place", "source_key", "key", "id", "size", "text_crc32")
    position = F.col("start") + F.row_number().over(in_stretch) - 1
    total = max(n, 1)
    return (placed.join(starts, "stretch").withColumn("position", position)
            .withColumn("shard", F.expr(f"position * {n_shards} div {total}").cast("int"))
            .withColumn("slot", F.expr(f"position - (shard * {total}L + {n_shards - 1}) div {n_shards}"))
            .select("id", F.expr("CASE WHEN source_key <> '~' THEN substring(source_key, 2) END").alias("source"),
                    "size", "text_crc32", "shard", "slot"))
