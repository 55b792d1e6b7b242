"""Validation reports, over a data table and over table specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.lake import Lake, read
from tidemark.functions.rules import Rule, allowed, requires, violation
from tidemark.functions.text import split_columns_of
from tidemark.operators.validate import passed, validate, write_report
from tidemark.sources.specs import SPEC_COLUMNS, spec_rows as read_specs, validate_specs

EVENT_TYPES = ["click", "view", "purchase", "signup"]


def _event_rules() -> list[Rule]:
    value = F.col("value")
    return [
        allowed("event_type", EVENT_TYPES, "event_type not allowed"),
        violation(value < 0.5, "value too small"),
        requires(F.col("event_type") == "purchase", value >= 10, "purchase needs value"),
    ]


def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(read(spark, sf_dir, "events"), ["event_id"], _event_rules())


def validate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passed(validate(read(spark, sf_dir, "events"), ["event_id"], _event_rules()[:1]))


def validate_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as it reads back from its file."""
    lake = Lake(spark, sf_dir)
    path = f"{lake.layout.root}/report"
    write_report(validate_report(spark, sf_dir), path)
    return (spark.read.option("sep", "|").option("header", True)
            .schema("event_id bigint, errors string").csv(path))


# One table spec per customer, in SQL that both engines run. Each defect hangs
# on an attribute of the customer; NULL leaves the entry out of the document.
SPEC_ENTRIES = {
    "source_raw_job_type": """CASE WHEN c_nationkey = 1 THEN 'shell'
        WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'pyspark' ELSE 'python-shell' END""",
    "type_of_pull": "CASE WHEN c_acctbal < 3000 THEN 'full' ELSE 'incremental' END",
    "source_schema_name": "c_mktsegment",
    "source_table_name": "c_name",
    "nature_of_data": "CASE WHEN c_nationkey = 2 THEN 'static' WHEN c_nationkey < 12 THEN 'mutable' ELSE 'immutable' END",
    "target_db_name": "CASE WHEN c_nationkey = 3 THEN '  ' ELSE 'curated' END",
    "target_partition_columns": "CASE WHEN c_nationkey = 4 THEN NULL WHEN c_nationkey < 12 THEN 'region, day' ELSE 'None' END",
    "compute_capacity_source_raw": "CASE WHEN c_nationkey = 5 THEN 'many' WHEN c_nationkey = 6 THEN NULL ELSE '0.0625' END",
    "compute_capacity_raw_curated": "CASE WHEN c_nationkey = 7 THEN '0' ELSE '2' END",
    "raw_curated_worker_type": "CASE WHEN c_nationkey = 8 THEN 'G.9X' ELSE 'G.1X' END",
    "source_db_type": "CASE WHEN c_nationkey <> 9 THEN 'mysql' END",
    "parallel_pull": "CASE WHEN c_nationkey = 10 THEN 'maybe' WHEN c_nationkey < 18 THEN 'true' ELSE 'false' END",
    "shop_catalog_db_name": "CASE WHEN c_nationkey <> 11 THEN 'shop' END",
    "shop_catalog_table_name": "CASE WHEN c_nationkey <> 12 THEN c_name END",
    "hashfield": "CASE WHEN c_nationkey <> 13 THEN 'id' END",
    "hashpartitions": "CASE WHEN c_nationkey = 17 THEN 'many' WHEN c_nationkey <> 14 THEN '3' END",
    "bookmark_key": "CASE WHEN c_nationkey <> 15 THEN 'changed_at, id' END",
    "bookmark_key_order": "CASE WHEN c_nationkey = 16 THEN 'up' ELSE 'asc' END",
    "primary_key": "CASE WHEN c_nationkey NOT IN (0, 17) THEN 'id' END",
    "target_table_name": "CASE WHEN c_nationkey = 20 THEN 'shared-' || c_mktsegment END",
}


def _write_documents(spark: SparkSession, sf_dir: str) -> str:
    path = f"{Lake(spark, sf_dir).layout.root}/specs"
    entry = F.struct(*(F.expr(sql).alias(name) for name, sql in SPEC_ENTRIES.items()))
    document = F.to_json(F.struct(F.array(entry).alias("job_parameters")))
    read(spark, sf_dir, "customer").select(document.alias("value")).write.text(path)
    return path


def spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = read_specs(spark, _write_documents(spark, sf_dir), multi_line=False)
    return specs.withColumns({
        "n_partition_columns": F.size(split_columns_of("target_partition_columns")),
        "n_bookmark_keys": F.size(split_columns_of("bookmark_key")),
    })


def spec_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_specs(read_specs(spark, _write_documents(spark, sf_dir), multi_line=False))


QUERIES = {
    "validate_report": validate_report,
    "validate_gate": validate_gate,
    "validate_report_file": validate_report_file,
    "spec_rows": spec_rows,
    "spec_report": spec_report,
}

_REPORT = """SELECT * FROM (
  SELECT event_id, concat_ws(', ',
    CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'event_type not allowed' END,
    CASE WHEN value < 0.5 THEN 'value too small' END,
    CASE WHEN event_type = 'purchase' AND value < 10 THEN 'purchase needs value' END) AS errors
  FROM events) WHERE errors <> ''"""

_SPECS = "WITH specs AS (SELECT {} FROM customer)".format(
    ", ".join(f"{sql} AS {name.removeprefix('shop_')}" for name, sql in SPEC_ENTRIES.items()))
_GIVEN = {name.removeprefix("shop_") for name in SPEC_ENTRIES}


def _blank(column: str) -> str:
    return f"coalesce(trim({column}), '') = ''"


# In the order in which the rules report.
_SPEC_RULES = [
    ("source_raw_job_type NOT IN ('python-shell', 'pyspark')",
     "source_raw_job_type must be one of: python-shell, pyspark"),
    ("nature_of_data NOT IN ('mutable', 'immutable')", "nature_of_data must be one of: mutable, immutable"),
    (_blank("target_db_name"), "target_db_name must not be blank"),
    (_blank("target_partition_columns"), "target_partition_columns must not be blank"),
    ("coalesce(try_cast(compute_capacity_source_raw AS DOUBLE), 0) <= 0",
     "compute_capacity_source_raw must be a number above 0"),
    ("coalesce(try_cast(compute_capacity_raw_curated AS DOUBLE), 0) <= 0",
     "compute_capacity_raw_curated must be a number above 0"),
    ("raw_curated_worker_type NOT IN ('Standard', 'G.1X', 'G.2X')",
     "raw_curated_worker_type must be one of: Standard, G.1X, G.2X"),
    ("source_raw_job_type = 'python-shell' AND source_db_type IS NULL",
     "source_db_type must be mysql or postgres for a python-shell source"),
    ("source_raw_job_type = 'pyspark' AND parallel_pull NOT IN ('true', 'false')",
     "parallel_pull must be true or false for a pyspark source"),
    ("source_raw_job_type = 'pyspark' AND catalog_db_name IS NULL",
     "the catalog database name is needed for a pyspark source"),
    ("source_raw_job_type = 'pyspark' AND catalog_table_name IS NULL",
     "the catalog table name is needed for a pyspark source"),
    ("parallel_pull = 'true' AND (hashfield IS NULL OR hashpartitions IS NULL)",
     "hashfield and hashpartitions are needed for a parallel pull"),
    ("parallel_pull = 'true' AND NOT regexp_full_match(hashpartitions, '0*[1-9][0-9]*')",
     "hashpartitions must be a positive integer"),
    ("source_raw_job_type <> 'pyspark' AND parallel_pull NOT IN ('true', 'false')",
     "parallel_pull must be true or false"),
    ("type_of_pull = 'incremental' AND (bookmark_key IS NULL OR bookmark_key_order NOT IN ('asc', 'desc'))",
     "bookmark_key and an order of asc or desc are needed for an incremental pull"),
    ("nature_of_data = 'mutable' AND type_of_pull = 'incremental' AND primary_key IS NULL",
     "primary_key is needed for an incremental pull of mutable data"),
    ("""count(*) OVER (PARTITION BY regexp_replace(trim(target_db_name), '[^A-Za-z0-9_]', '_', 'g'), lower(
        regexp_replace(coalesce(target_table_name, source_table_name), '[^A-Za-z0-9_]', '_', 'g'))) > 1""",
     "another spec has the same target table"),
]

SQL = {
    "validate_report": _REPORT,
    "validate_gate": """SELECT count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')) = 0
  AS passed FROM events""",
    "validate_report_file": _REPORT,
    "spec_rows": f"""{_SPECS} SELECT {", ".join(
        name if name in _GIVEN else f"NULL::VARCHAR AS {name}" for name in SPEC_COLUMNS)},
  (CASE WHEN target_partition_columns IS NULL THEN 0
    ELSE len(string_split(target_partition_columns, ',')) END)::INTEGER AS n_partition_columns,
  (CASE WHEN bookmark_key IS NULL THEN 0 ELSE len(string_split(bookmark_key, ',')) END)::INTEGER AS n_bookmark_keys
FROM specs""",
    "spec_report": f"""{_SPECS} SELECT * FROM (
  SELECT source_schema_name, source_table_name, concat_ws(', ', {", ".join(
      f"CASE WHEN {condition} THEN '{message}' END" for condition, message in _SPEC_RULES)}) AS "Errors"
  FROM specs) WHERE "Errors" <> ''""",
}
