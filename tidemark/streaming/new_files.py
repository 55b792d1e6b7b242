"""Each new file (or each newly logged batch) exactly once across runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from tidemark.operators.latest import latest_by
from tidemark.plans.bookmarks import LOG_SCHEMA
from tidemark.plans.load import curated_table, load_batch
from tidemark.sources.raw import BATCH, read_batches
from tidemark.spec import Layout, TableSpec
from tidemark.storage import exists, read_marker, write_marker


def new_files(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Stream of the parquet files below `path`, for folders that other tools fill.

    However old a file's stamp is: by default a stream passes over files that
    are a week older than the newest one.
    """
    return spark.readStream.schema(schema).option("maxFileAge", "36500d").parquet(path)


def run_available(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Hand everything not yet consumed to `apply`, then stop.

    The checkpoint remembers what was consumed; a batch whose `apply` failed is
    handed over again, with the same number, by the next run.
    """
    query = (stream.writeStream.foreachBatch(apply)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def load_new_files(spark: SparkSession, spec: TableSpec, layout: Layout,
                   schema: T.StructType | str, workflow: str = "files") -> None:
    """Load the files that have appeared in the raw folder since the last run.

    For a folder without batches, and for increments: files do not say which of them
    belong to one full pull. All new files form one load; of a mutable row that
    several of them hold, the version that is last by the bookmark key is loaded.
    Deleting the checkpoint folder makes every file new again.
    """
    if spec.type_of_pull == "full":
        raise ValueError(f"{spec.source}: full pulls need batches, plain files may be several of them")
    checkpoint = layout.checkpoint(spec, workflow)
    stream_id = read_marker(spark, f"{checkpoint}/id")
    if stream_id is None:
        # Batch numbers start again with a new checkpoint, so they need a name.
        stream_id = uuid.uuid4().hex
        write_marker(spark, f"{checkpoint}/id", stream_id)

    def apply(batch: DataFrame, epoch: int) -> None:
        rows = batch.drop(BATCH)
        if spec.nature_of_data == "mutable":
            rows = latest_by(rows, spec.primary_keys, spec.bookmark_keys, spec.bookmark_key_order)
        load_batch(rows, spec, layout, load_id=f"{stream_id}-{epoch}")

    run_available(new_files(spark, layout.raw(spec), schema), f"{checkpoint}/stream", apply)
    _refresh(spark, spec, layout)


def load_logged_batches(spark: SparkSession, spec: TableSpec, layout: Layout, workflow: str) -> list[str]:
    """`logged_loads`, and only how each batch was loaded."""
    return [mode for _, mode in logged_loads(spark, spec, layout, workflow)]


def logged_loads(spark: SparkSession, spec: TableSpec, layout: Layout, workflow: str) -> list[tuple[str, str]]:
    """Load the batches that have been logged since the last run: their ids, and how.

    The stream is over the bookmark log, one tiny file per batch, so that a run
    never lists the raw history and never sees a batch that is still landing.
    Unread full pulls are overtaken by the newest one; unread increments are
    loaded one by one in order, each by its own schema, so that the later
    version of a row wins. Batches are loaded in order, so what is not newer than
    the last finished one is done, also when the checkpoint is lost.
    """
    loads: list[tuple[str, str]] = []
    entries = layout.bookmarks(spec, workflow)
    if not exists(spark, entries):
        return loads

    def apply(log: DataFrame, _epoch: int) -> None:
        session = log.sparkSession
        ids = sorted(row[BATCH] for row in log.select(BATCH).distinct().collect())
        journal = curated_table(session, spec, layout).journal
        finished = next((i for i in reversed(ids) if journal.finished(f"{workflow}-{i}")), "")
        ids = [i for i in ids if i > finished]
        for batch_id in ids[-1:] if spec.type_of_pull == "full" else ids:
            batch = read_batches(session, layout.raw(spec, workflow), [batch_id])
            mode = load_batch(batch, spec, layout, load_id=f"{workflow}-{batch_id}", has_rows=True)
            if mode is not None:
                loads.append((batch_id, mode))

    run_available(new_files(spark, entries, LOG_SCHEMA), f"{layout.checkpoint(spec, workflow)}/stream", apply)
    _refresh(spark, spec, layout)
    return loads


def _refresh(spark: SparkSession, spec: TableSpec, layout: Layout) -> None:
    # The stream wrote in a session of its own; this one may hold old listings.
    table = curated_table(spark, spec, layout)
    if table.exists():
        spark.catalog.refreshTable(table.name)
