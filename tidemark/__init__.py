"""Parameter-driven table ingestion on Spark: source → raw → curated."""

from tidemark.plans.chain import RunFailed, TableResult, pull, pull_to_raw, run_all, run_file, run_table
from tidemark.plans.load import load_batch
from tidemark.sources.jdbc import JdbcSource
from tidemark.spec import Layout, TableSpec

__all__ = ["JdbcSource", "Layout", "RunFailed", "TableResult", "TableSpec", "load_batch", "pull",
           "pull_to_raw", "run_all", "run_file", "run_table"]
