from tidemark.sources.jdbc import JdbcSource, hash_bucket, hash_predicates, pull_table, range_predicates
from tidemark.sources.raw import append_files, batch_counts, batches, land, raw_scan, read_batches
from tidemark.sources.specs import conform_specs, spec_rows, spec_rules, validate_specs

__all__ = [
    "JdbcSource", "append_files", "batch_counts", "batches", "conform_specs", "hash_bucket",
    "hash_predicates", "land", "pull_table", "range_predicates", "raw_scan", "read_batches", "spec_rows",
    "spec_rules", "validate_specs",
]
