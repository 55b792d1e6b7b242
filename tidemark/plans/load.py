"""The load rule: what a batch does to its curated table."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame

from tidemark.plans.curated import APPEND, CREATE, MERGE, REPLACE, CuratedTable, ensure_database
from tidemark.spec import Layout, TableSpec

log = logging.getLogger(__name__)


def choose_mode(table_exists: bool, nature_of_data: str, type_of_pull: str) -> str:
    """The first load creates; full pulls replace; incremental pulls append
    immutable data and merge mutable data."""
    if not table_exists:
        return CREATE
    if type_of_pull == "full":
        return REPLACE
    return APPEND if nature_of_data == "immutable" else MERGE


def curated_table(spark, spec: TableSpec, layout: Layout) -> CuratedTable:
    return CuratedTable(spark, spec.database, spec.table, layout.curated(spec),
                        spec.partitions, layout.state(spec),
                        spec.primary_keys if spec.nature_of_data == "mutable" else ())


def load_batch(batch: DataFrame, spec: TableSpec, layout: Layout, load_id: str | None = None,
               has_rows: bool = False) -> str | None:
    """Apply one batch and return what was done; None if there was nothing to do.

    An empty batch changes nothing, even as a full pull. With a `load_id` the
    load takes effect exactly once, however often it is repeated after a crash.
    `has_rows` says that the batch is known not to be empty, which saves a job.
    The batch is read several times: it must be one that is landed, not a view of
    a source where rows can arrive in between.
    """
    spark = batch.sparkSession
    load_id = load_id or uuid.uuid4().hex
    table = curated_table(spark, spec, layout)
    table.recover()
    if table.journal.finished(load_id):
        return None
    if not has_rows and batch.isEmpty():
        log.info("%s: no rows, nothing loaded", spec.source)
        return None
    ensure_database(spark, spec.database, f"{layout.root}/databases/{spec.database}")
    mode = choose_mode(table.exists(), spec.nature_of_data, spec.type_of_pull)
    table.journal.start(load_id, mode)
    if mode == CREATE:
        table.create(batch)
    elif mode == APPEND:
        table.append(batch)
    elif mode == REPLACE:
        table.replace(batch, load_id)
    else:
        table.merge(batch, spec.primary_keys, load_id)
    if mode in (CREATE, APPEND):  # the others are finished by their publication
        table.journal.finish(load_id)
    log.info("%s: %s", spec.source, mode)
    return mode
