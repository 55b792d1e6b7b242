"""Mix sources to target weights, exactly to the word.

Rows get hash-random keys. No task holds a source's rows; one row per source is ranked
in one task, so more than `MOST_SOURCES` sources are refused. Within each source they are put in key order, a
distributed prefix sum of their sizes is taken (bucket totals first, then rows
within a bucket), and the order is cut at the source's budget. A budget above
the source's size repeats whole epochs before the cut.

Defined cases: a NULL text has size 0; a NULL source is a source of its own and
comes last; rows equal in id, source and text are one unit whose cut is shared
evenly; a source without words has target 0; an empty table gives an empty
result. Other columns of the input do not matter to `mix_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import bucket_count, n_words, saved

WEIGHTS = (5, 2, 1)
MOST_SOURCES = 100_000


def _part(text: Column) -> Column:
    """A text led by its length, or `~` for NULL: parts one after the other stay apart."""
    return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("~"))


def unit_key(seed: int, id_col: str, source: str, text: str) -> Column:
    """Hash-random and the same in every run; equal rows have equal keys, and no others."""
    digest = F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("~"))
    parts = F.concat(F.lit(str(seed)), _part(F.col(id_col).cast("string")), _part(F.col(source).cast("string")), digest)
    return F.md5(parts.cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """`target` of each row of (source_key, source, source_size): one row a source.

    With the sources in order of cap / weight, the ones that reach their cap
    come first; the others divide what is left by weight.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    weighted = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn - 1) % len(weights) + 1).cast("long"))
    by_ratio = Window.partitionBy().orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = (weighted
              .withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
              .withColumn("capped", F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)))
              .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("capped"))
                          / F.col("rest")))
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source_key", "level"))).over(everything)
    whole = (F.lit(cap) * F.col("source_size")).cast("double")
    target = F.least(whole, F.coalesce(first["level"] * F.col("weight"), whole))
    return levels.select("source_key", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 42) -> DataFrame:
    """One row per unit: key, id, copies, size, source_size, target, taken (words of each copy)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"),
                       n_words(text).alias("size"), unit_key(seed, id_col, source, text).alias("key"))
    units = saved(rows.groupBy("key", "id", "source", "size").agg(F.count("*").alias("copies")), "mix")
    buckets = bucket_count(units.count())
    units = (units
             .withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")))
             .withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
                                                * F.lit(buckets), 28)))
    totals = units.groupBy("source_key", "source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    sources = saved(totals.groupBy("source_key", "source").agg(F.sum("words").alias("source_size")), "sources")
    if sources.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; mix by a coarser column")
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (totals.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
              .join(source_targets(sources, weights, share, cap), "source_key")
              .select("source_key", "bucket", "start", "source_size", "target"))
    within = (Window.partitionBy("source_key", "bucket").orderBy("key", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    begin = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size") * F.col("copies"), left - F.col("begin")))
    return (units.join(starts, ["source_key", "bucket"])
            .withColumn("begin", begin).withColumn("epochs", epochs)
            .withColumn("taken", (F.col("epochs") * F.col("size") + F.floor(cut / F.col("copies"))).cast("long"))
            .select("key", "id", "copies", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                    n_chars: str = "n_chars", seed: int = 42, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the input's columns.

    The one document at a source's cut is taken up to its last word within the
    budget; `n_chars`, if there is such a column, then counts what is left.
    Rows of which no word is taken are not in the mix.
    """
    plan = mix_plan(docs, id_col, text, source, seed=seed, **options)
    plan = plan.select(F.struct("size", "taken").alias("__mix"), F.col("key").alias("__key"))
    joined = docs.withColumn("__key", unit_key(seed, id_col, source, text)).join(plan, "__key")
    size, taken = F.col("__mix.size"), F.col("__mix.taken")
    turns = F.when(taken > 0, F.sequence(F.lit(0), F.ceil(taken / size).cast("int") - 1))
    each = joined.withColumn("__turn", F.explode(turns))
    words = F.least(size, taken - F.col("__turn") * size)
    spans = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(words < size, F.array_join(F.slice(spans, F.lit(1), words.cast("int")), "")).otherwise(F.col(text))
    each = each.withColumn(text, cut)
    if n_chars in docs.columns:
        each = each.withColumn(n_chars, F.when(words < size, F.length(text)).otherwise(F.col(n_chars))
                               .cast(docs.schema[n_chars].dataType))
    return each.select(*[F.col(f"`{c}`") for c in docs.columns])
