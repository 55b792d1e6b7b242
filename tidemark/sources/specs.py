"""Table specs: the JSON parameter document as rows, and the rules it must obey."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.rules import Rule, allowed, not_blank, positive, requires, violation
from tidemark.functions.text import is_blank
from tidemark.operators.validate import validate
from tidemark.spec import (
    DATABASE_TYPES, DATA_NATURES, JOB_TYPES, KEY_ORDERS, PULL_TYPES, WORKER_TYPES, TableSpec,
)

SIZING = ("source_raw_job_type", "compute_capacity_source_raw", "compute_capacity_raw_curated",
          "raw_curated_worker_type", "source_raw_worker_type")
SPEC_COLUMNS = tuple(f.name for f in fields(TableSpec)) + SIZING


def spec_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per element of the array `job_parameters`, every column text.

    A parameter file is one document (`multi_line`); a folder of one document
    per line is read in parallel with ``multi_line=False``. Fields may carry a
    prefix, as in ``<vendor>_catalog_db_name``. A document that is no JSON, or
    lacks the array, stops the run: its tables would go unnoticed otherwise.
    """
    document = (spark.read.option("multiLine", multi_line).option("primitivesAsString", True)
                .option("mode", "FAILFAST").json(path))
    if "job_parameters" not in document.columns:
        raise ValueError(f"{path} has no job_parameters")
    document = document.withColumn("job_parameters", F.coalesce("job_parameters", F.raise_error(
        F.lit(f"a document in {path} has no job_parameters")).cast(document.schema["job_parameters"].dataType)))
    rows = document.select(F.explode("job_parameters").alias("p")).select("p.*")
    return conform_specs(rows)


def conform_specs(rows: DataFrame) -> DataFrame:
    """All spec columns in a fixed order; those the document lacks are NULL.

    Rows of several documents may carry several prefixes; each row's own counts.
    """
    def source_of(name: str):
        prefixed = [c for c in rows.columns if name.startswith("catalog_") and c.endswith(f"_{name}")]
        given = [F.col(f"`{c}`").cast("string") for c in (name, *prefixed) if c in rows.columns]
        return F.coalesce(*given) if given else F.lit(None).cast("string")

    return rows.select(*(source_of(name).alias(name) for name in SPEC_COLUMNS))


def spec_rules() -> list[Rule]:
    job, pull, nature = (F.col(c) for c in ("source_raw_job_type", "type_of_pull", "nature_of_data"))
    spark_job = job == "pyspark"
    incremental = pull == "incremental"
    parallel = F.col("parallel_pull") == "true"

    def given(column: str):
        return ~is_blank(column)

    return [
        allowed("source_raw_job_type", JOB_TYPES),
        allowed("type_of_pull", PULL_TYPES),
        not_blank("source_schema_name"),
        not_blank("source_table_name"),
        allowed("nature_of_data", DATA_NATURES),
        not_blank("target_db_name"),
        not_blank("target_partition_columns"),
        positive("compute_capacity_source_raw"),
        positive("compute_capacity_raw_curated"),
        allowed("raw_curated_worker_type", WORKER_TYPES),
        requires(job == "python-shell", F.col("source_db_type").isin(*DATABASE_TYPES),
                 "source_db_type must be mysql or postgres for a python-shell source"),
        requires(spark_job, F.col("parallel_pull").isin("true", "false"),
                 "parallel_pull must be true or false for a pyspark source"),
        requires(spark_job, given("catalog_db_name"),
                 "the catalog database name is needed for a pyspark source"),
        requires(spark_job, given("catalog_table_name"),
                 "the catalog table name is needed for a pyspark source"),
        requires(parallel, given("hashfield") & given("hashpartitions"),
                 "hashfield and hashpartitions are needed for a parallel pull"),
        requires(parallel & given("hashpartitions"), F.col("hashpartitions").rlike(r"^\s*0*[1-9][0-9]*\s*$"),
                 "hashpartitions must be a positive integer"),
        requires(~spark_job & given("parallel_pull"), F.col("parallel_pull").isin("true", "false"),
                 "parallel_pull must be true or false"),
        requires((job != "python-shell") & given("source_db_type"), F.col("source_db_type").isin(*DATABASE_TYPES),
                 "source_db_type must be mysql or postgres"),
        requires(incremental, given("bookmark_key") & F.col("bookmark_key_order").isin(*KEY_ORDERS),
                 "bookmark_key and an order of asc or desc are needed for an incremental pull"),
        requires((nature == "mutable") & incremental, given("primary_key"),
                 "primary_key is needed for an incremental pull of mutable data"),
    ]


def validate_specs(specs: DataFrame) -> DataFrame:
    """`(source_schema_name, source_table_name, Errors)` of the failing specs.

    Besides the rules for one spec, no two may have the same target table, or the same
    source, whose name is that of their folders. Only these names are shuffled, counted within
    tasks first, and only those that occur twice are joined back.
    """
    def name(*columns: Column) -> Column:
        return F.lower(F.concat_ws(".", *(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_]", "_") for c in columns)))

    table = F.when(is_blank("target_table_name"), F.col("source_table_name")).otherwise(F.col("target_table_name"))
    source = F.lower(F.concat_ws(".", "source_schema_name", "source_table_name"))
    named = specs.withColumns({"_target": name(F.col("target_db_name"), table), "_source": source})

    def twice(key: str) -> DataFrame:
        return named.groupBy(key).count().filter("count > 1").select(key, F.lit(True).alias(f"{key}_twice"))

    counted = named.join(twice("_target"), "_target", "left").join(twice("_source"), "_source", "left")
    rules = [*spec_rules(),
             violation(F.col("_target_twice").isNotNull(), "another spec has the same target table"),
             violation(F.col("_source_twice").isNotNull(), "another spec has the same source table")]
    return validate(counted, ["source_schema_name", "source_table_name"], rules, errors="Errors")
