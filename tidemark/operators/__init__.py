from tidemark.operators.counts import row_counts
from tidemark.operators.latest import latest_by
from tidemark.operators.marks import high_water, low_water, water_mark
from tidemark.operators.merge import (
    affected_partitions, batch_keys, encode_partitions, key_filter, key_range,
    matched_key_partitions, partition_predicate, restrict_to_partitions, upsert,
)
from tidemark.operators.validate import passed, require_clean, validate, write_report

__all__ = [
    "affected_partitions", "batch_keys", "encode_partitions", "high_water", "key_filter", "key_range",
    "latest_by", "low_water", "matched_key_partitions", "partition_predicate", "passed",
    "require_clean", "restrict_to_partitions", "row_counts", "upsert", "validate",
    "water_mark", "write_report",
]
