"""Writers of a curated table: external, catalogued, optionally partitioned parquet.

Rows that replace stored rows are written once, to a fresh folder of their own, and
published by pointing the catalog at it: each partition (or the table, if it has
none) is either still the old one or already the new one, and a stored row is only
removed when its successor is durable and in the catalog. A marker lists what is to be
swapped, so an interrupted publication is repeated. What partitions a table has and
where they lie is therefore for the catalog to say, not for the folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameWriter, Row, SparkSession, functions as F, types as T

from tidemark.functions.columns import conform, fold, resolve
from tidemark.functions.lattice import extended
from tidemark.functions.literals import quote, sql_text
from tidemark.operators.merge import (
    affected_partitions, batch_keys, encode_partitions, key_filter, restrict_to_partitions, upsert,
)
from tidemark.plans.journal import Journal
from tidemark.sessions import adopt, planned_bytes, private_session, size_shuffles
from tidemark.storage import (
    child_names, delete, delete_uri, exists, folder_bytes, qualified, read_marker, write_marker,
)


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    where = f" LOCATION {sql_text(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(name)}{where}")


CREATE, APPEND, REPLACE, MERGE = "create", "append", "replace", "merge"
# An empty text, and the folder name that stands for NULL.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
STORED_AS_NULL = ("", NULL_FOLDER)
#: Partitions named in one statement, and statements or deletions under way at a time.
AT_ONCE, CALLS = 100, 8


def _each(call: Callable, items: Iterable) -> None:
    """For calls that wait for a catalog or a store; the first error is raised."""
    with ThreadPoolExecutor(max_workers=CALLS) as pool:
        list(pool.map(call, items))


class CuratedTable:
    """One curated table. All its writes run in a session of its own."""

    def __init__(self, spark: SparkSession, database: str, table: str, path: str,
                 partitions: Sequence[str], state: str, clustered_by: Sequence[str] = ()) -> None:
        self.spark = spark
        self.name = quote(database, table)
        self.path = path
        self.partitions = list(partitions)
        self.clustered_by = list(clustered_by)
        if self.exists():
            self._take_partitions_of_table()
        self.state = state
        self.journal = Journal(spark, state)
        self._versions = f"{state}/versions"
        self._keys = f"{state}/staging/keys"
        self._ready = f"{state}/staging/ready"

    @cached_property
    def _session(self) -> SparkSession:
        return private_session(self.spark)

    # ------------------------------------------------------------ reading

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    # ------------------------------------------------------------ writing

    def create(self, batch: DataFrame) -> None:
        """First load. Leftovers of an earlier, interrupted one are replaced."""
        self.partitions = resolve(batch, self.partitions)
        batch = self._normalised(adopt(self._session, batch))
        delete(self.spark, self._versions)
        # The options stay with the table and hold for later appends as well.
        self._writer(batch).format("parquet").option("path", self.path).saveAsTable(self.name)
        self._refresh()

    def append(self, batch: DataFrame) -> None:
        """Add the batch; the stored rows are neither read nor touched."""
        self._clustered(self._aligned(batch)).write.mode("append").insertInto(self.name)
        self._refresh()

    def replace(self, batch: DataFrame, load_id: str | None = None) -> None:
        """Replace all rows of the table, once their successors are staged: a batch
        that cannot be written leaves the table as it is."""
        self._stage(self._aligned(batch), load_id)
        self._publish()

    def merge(self, batch: DataFrame, primary_key: Sequence[str], load_id: str | None = None) -> None:
        """Upsert by key, rewriting the affected partitions (or the whole table
        if it has none)."""
        batch = self._aligned(batch)
        primary_key = resolve(batch, primary_key)
        keys = self._stage_keys(batch, primary_key)
        target, affected = self._stored(), None
        if self.partitions:
            affected = self._affected_by(keys, primary_key)
            target = restrict_to_partitions(target, affected, self.partitions)
        self._size_shuffles(target, batch)
        self._stage(upsert(target, batch, primary_key, keys), load_id, affected)
        self._publish()

    def purge(self, condition: Column | None = None) -> None:
        """Remove whole partitions, those for which `condition` on partition
        columns holds, or every row if there is no condition."""
        if condition is None and not self.partitions:
            self.replace(self._session.createDataFrame([], self._stored().schema))
            return
        if not self.partitions:
            raise ValueError("a table without partitions can only be purged as a whole")
        self._empty(self._folders(self._stored() if condition is None else self._stored().filter(condition)))
        self._refresh()

    def recover(self) -> None:
        """Bring the table back to a state between two loads: finish a
        publication that was cut short, undo any other load that was. Call
        before a load."""
        if self.exists():
            self._refresh()  # whoever wrote last may have been another session
        if exists(self.spark, self._ready):
            self._publish()
        mode, load_id = self.journal.interrupted()
        if load_id is not None:
            delete(self.spark, f"{self._versions}/{load_id}")  # written, but not to be published
        if mode == APPEND and self.exists():
            self._undo_append()
        elif mode == CREATE and self.exists():
            self.spark.sql(f"DROP TABLE {self.name}")
        self.journal.clear()

    # ---------------------------------------------------- schema evolution

    def evolve(self, schema: T.StructType) -> list[str]:
        """Add the columns, and the fields of structs at any depth, that the table lacks;
        stored rows read NULL in them. Types of known columns and fields stay."""
        stored, folded = self.read().schema, partial(fold, self.spark)
        known = {folded(c) for c in stored.names}
        wanted = extended(stored, schema, folded)
        added = [f for f in wanted.fields if folded(f.name) not in known]
        if any(f.dataType != wanted[f.name].dataType for f in stored.fields):
            self._redefine(wanted)
        elif added:
            self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({T.StructType(added).toDDL()})")
        if wanted != stored:
            self._refresh()
        return [f.name for f in added]

    def _redefine(self, schema: T.StructType) -> None:
        """Give the table other columns over the same files, in one change of its catalog entry: SQL
        adds columns, but no fields to those that are there."""
        data = T.StructType([f for f in schema.fields if f.name not in self.partitions])
        state = self.spark._jsparkSession.sessionState()
        state.catalog().alterTableDataSchema(state.sqlParser().parseTableIdentifier(self.name),
                                             self.spark._jsparkSession.parseDataType(data.json()))

    # ------------------------------------------------------------- helpers

    def _take_partitions_of_table(self) -> None:
        """The stored order and spelling. Writing by other partitions than the
        table has would replace the wrong rows."""
        stored = [c.name for c in self.spark.catalog.listColumns(self.name) if c.isPartition]
        if {fold(self.spark, p) for p in stored} != {fold(self.spark, p) for p in self.partitions}:
            raise ValueError(f"{self.name} is partitioned by {stored}, not by {self.partitions}")
        self.partitions = stored

    def _stored(self) -> DataFrame:
        return self._session.table(self.name)

    def _refresh(self) -> None:
        """Both sessions cache listings of their own."""
        for session in (self.spark, self._session):
            session.catalog.refreshTable(self.name)

    def _normalised(self, batch: DataFrame) -> DataFrame:
        """Spark stores some partition values as NULL. Making them NULL beforehand
        keeps a row's value in step with the partition it ends up in."""
        kinds = {fold(self.spark, f.name): f.dataType for f in batch.schema.fields}
        text = [p for p in self.partitions if isinstance(kinds[fold(self.spark, p)], T.StringType)]
        stored = {p: F.when(~F.col(quote(p)).isin(*STORED_AS_NULL), F.col(quote(p))) for p in text}
        return batch.withColumns(stored) if text else batch

    def _aligned(self, batch: DataFrame) -> DataFrame:
        """The batch with the table's columns, order and types, after the table
        has been given the batch's new columns."""
        self.evolve(batch.schema)
        batch = self._normalised(adopt(self._session, batch))
        present = {fold(self.spark, f.name): f for f in batch.schema.fields}
        columns = []
        for wanted in self.read().schema.fields:
            given = present.get(fold(self.spark, wanted.name))
            if given is None:
                column = F.lit(None).cast(wanted.dataType)
            else:
                column = conform(F.col(quote(given.name)), given.dataType, wanted.dataType, given.name,
                                 partial(fold, self.spark))
            columns.append(column.alias(wanted.name))
        return batch.select(*columns)

    def _spread(self, df: DataFrame) -> DataFrame:
        """One shuffle by partition value, so that each partition gets few files;
        adaptive execution splits a partition that holds much of the data."""
        return df.hint("rebalance", *self.partitions) if self.partitions else df

    def _keys_of(self, df: DataFrame) -> list[str]:
        """The key columns as `df` spells them, those it lacks left out."""
        present = {fold(self.spark, c): c for c in df.columns}
        return [present[fold(self.spark, k)] for k in self.clustered_by if fold(self.spark, k) in present]

    def _clustered(self, df: DataFrame) -> DataFrame:
        """Spread, and within each task in order of the key: a page of a file then holds a short range of
        keys, so that looking for a few of them opens a few pages."""
        keys = [k for k in self._keys_of(df) if k not in self.partitions]
        if not keys:
            return self._spread(df)
        return self._spread(df).sortWithinPartitions(*(quote(c) for c in [*self.partitions, *keys]))

    def _writer(self, df: DataFrame) -> DataFrameWriter:
        """Overwrites with clustered rows, a Bloom filter for each key column and row group, sized to its values."""
        writer = self._clustered(df).write.mode("overwrite").option("compression", "snappy")
        for key in self._keys_of(df):
            if key not in self.partitions and "." not in key and not isinstance(df.schema[key].dataType, T.BooleanType):
                writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        return writer.partitionBy(*self.partitions) if self.partitions else writer

    def _size_shuffles(self, *inputs: DataFrame) -> None:
        sizes = [planned_bytes(df) for df in inputs]
        if None in sizes:
            folders = [f for f in (self.path, self._versions) if exists(self.spark, f)]
            stored = sum(folder_bytes(self.spark, folder) for folder in folders)
            sizes = [stored if s is None else s for s in sizes]
        size_shuffles(self._session, self.spark.conf.get("spark.sql.shuffle.partitions"), sum(sizes))

    def _stage_keys(self, batch: DataFrame, primary_key: Sequence[str]) -> DataFrame:
        """The batch's keys as a table of their own: read twice, small, and of a
        size the optimizer knows when it chooses how to join."""
        keys = batch_keys(batch, primary_key, self.partitions)
        self._size_shuffles(keys)
        keys.write.mode("overwrite").parquet(self._keys)
        return self._session.read.schema(keys.schema).parquet(self._keys)

    def _affected_by(self, keys: DataFrame, primary_key: Sequence[str]) -> list[Row]:
        """Affected partitions, those included that only lose rows; as text, and
        bounded by the number of partitions."""
        target = self._stored()
        fixed = [p for p in self.partitions if p in primary_key]
        if fixed == self.partitions:
            # The key decides the partition: no stored row can be elsewhere.
            return encode_partitions(keys.select(*self.partitions).distinct(), self.partitions).collect()
        if fixed:
            # Stored matches agree with the batch in these columns: read no more.
            reachable = encode_partitions(keys, fixed).distinct().collect()
            target = restrict_to_partitions(target, reachable, fixed)
        wanted = key_filter(keys, primary_key)
        if wanted is not None:
            target = target.filter(wanted)
        self._size_shuffles(target.select(*primary_key, *self.partitions), keys)
        affected = affected_partitions(target, keys, primary_key, self.partitions)
        return encode_partitions(affected, self.partitions).collect()

    @staticmethod
    def _files(rows: DataFrame) -> DataFrame:
        """The files that hold the given rows: no column is read, and nothing is computed for each row."""
        return rows.select(F.col("_metadata.file_path").alias("_file")).distinct()

    def _folders(self, rows: DataFrame) -> dict[str, str]:
        """The partition folders that hold the given rows, by the part of their path that names the
        partition. One job; its result is bounded by the number of files, which were listed anyhow."""
        found = {row["_file"].rpartition("/")[0] for row in self._files(rows).collect()}
        return {"/".join(unquote(f).split("/")[-len(self.partitions):]): f for f in sorted(found)}

    def _named(self, tail: str) -> str:
        """A partition in SQL, from the end of its folder's path."""
        values = [unquote(part.partition("=")[2]) for part in tail.split("/")]
        return "PARTITION (" + ", ".join(
            f"{quote(p)} = {sql_text(None if v == NULL_FOLDER else v)}" for p, v in zip(self.partitions, values)) + ")"

    def _alter(self, what: str, clauses: list[str], joint: str = " ") -> None:
        """One statement for every `AT_ONCE` partitions."""
        for at in range(0, len(clauses), AT_ONCE):
            self.spark.sql(f"ALTER TABLE {self.name} {what} {joint.join(clauses[at:at + AT_ONCE])}")

    def _stage(self, rows: DataFrame, load_id: str | None, affected: list[Row] | None = None) -> None:
        """Write the new rows to a folder of their own, then the marker that says they may be
        published: where each partition is to be, and which folders it takes the place of.
        `affected` are the (encoded) partitions that the rows replace, by default all."""
        load_id = load_id or uuid.uuid4().hex
        version = f"{self._versions}/{load_id}"
        self._writer(rows).parquet(version)
        ready = {"load_id": load_id, "version": qualified(self.spark, version), "old": {}, "new": {}}
        if self.partitions:
            stored = self._stored()
            if affected is not None:
                stored = restrict_to_partitions(stored, affected, self.partitions)
            ready["old"] = self._folders(stored)
            ready["new"] = self._folders(self._session.read.schema(self.read().schema).parquet(version))
        write_marker(self.spark, self._ready, json.dumps(ready))

    def _publish(self) -> None:
        """Point the catalog at the new folders, then delete those they replace."""
        ready = json.loads(read_marker(self.spark, self._ready))
        old, new = ready["old"], ready["new"]
        if self.partitions:
            place = {tail: sql_text(unquote(folder)) for tail, folder in new.items()}
            # A partition without files may be in the catalog or not.
            self._alter("ADD IF NOT EXISTS", [f"{self._named(tail)} LOCATION {place[tail]}"
                                              for tail in sorted(new.keys() - old.keys())])
            _each(lambda tail: self.spark.sql(
                f"ALTER TABLE {self.name} {self._named(tail)} SET LOCATION {place[tail]}"), sorted(new))
            emptied = {tail: folder for tail, folder in old.items() if tail not in new}
            if emptied:
                self._empty(emptied)
            _each(lambda tail: self._delete_folder(old[tail]),
                  [tail for tail in sorted(old) if tail in new and old[tail] != new[tail]])
        else:
            self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION {sql_text(ready['version'])}")
            self._delete_others(ready["version"])
        self._refresh()
        self.journal.finish(ready["load_id"])
        delete(self.spark, self._ready)
        delete(self.spark, f"{self.state}/staging")

    def _delete_folder(self, uri: str) -> None:
        delete_uri(self.spark, uri)

    def _delete_others(self, version: str) -> None:
        """All files of a table without partitions but those of the given version."""
        kept = version.rsplit("/", 1)[1]
        folders = [self.path, *(f"{self._versions}/{name}" for name in child_names(self.spark, self._versions)
                                if name != kept)]
        _each(lambda folder: delete(self.spark, folder), folders)

    def _undo_append(self) -> None:
        """Delete the files that an interrupted append has added. They are looked
        for by path as well, since it may not have come to register new partitions."""
        sources = [self._stored()]
        if self.partitions and exists(self.spark, self.path):
            sources.append(self._session.read.schema(self.read().schema).parquet(self.path))
        added = set()
        for files in sources:
            found = files.filter(self.journal.written_since()).select(F.col("_metadata.file_path").alias("file"))
            added |= {row["file"] for row in found.distinct().collect()}
        _each(lambda file: delete_uri(self.spark, file), sorted(added))
        self._refresh()

    def _empty(self, folders: dict[str, str]) -> None:
        """Partitions that are to have no rows leave the catalog, then their files go: those of an
        external table would stay behind, to come back with the next append."""
        self._alter("DROP IF EXISTS", [self._named(tail) for tail in sorted(folders)], ", ")
        _each(lambda tail: self._delete_folder(folders[tail]), sorted(folders))
