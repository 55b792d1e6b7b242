"""What to do with one source table."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Row

from tidemark.functions.text import split_columns

# Fixed values of the table-spec format.
PULL_TYPES = ("full", "incremental")
DATA_NATURES = ("mutable", "immutable")
KEY_ORDERS = ("asc", "desc")
JOB_TYPES = ("python-shell", "pyspark")
DATABASE_TYPES = ("mysql", "postgres")
WORKER_TYPES = ("Standard", "G.1X", "G.2X")
NO_PARTITIONS = "None"


def catalog_identifier(name: str) -> str:
    """Spark catalog names hold letters, digits and underscores only."""
    return re.sub(r"\W", "_", name.strip(), flags=re.ASCII)


@dataclass(frozen=True)
class TableSpec:
    """One table of a parameter file; values are text, as in the file.

    Raises `ValueError` at once if the values contradict each other, so that no
    data moves on a broken spec.
    """

    source_schema_name: str
    source_table_name: str
    target_db_name: str
    type_of_pull: str = "full"
    nature_of_data: str = "mutable"
    target_partition_columns: str = NO_PARTITIONS
    primary_key: str = ""
    bookmark_key: str = ""
    bookmark_key_order: str = ""
    parallel_pull: str = "false"
    hashfield: str = ""
    hashpartitions: str = ""
    source_db_type: str = ""
    catalog_db_name: str = ""
    catalog_table_name: str = ""
    target_table_name: str = ""

    def __post_init__(self) -> None:
        for name in ("source_schema_name", "source_table_name", "target_db_name",
                     "target_partition_columns"):
            self._check(getattr(self, name).strip(), f"{name} must not be blank")
        self._check(self.type_of_pull in PULL_TYPES, "type_of_pull must be full or incremental")
        self._check(self.nature_of_data in DATA_NATURES, "nature_of_data must be mutable or immutable")
        self._check(self.parallel_pull in ("true", "false"), "parallel_pull must be true or false")
        self._check(self.source_db_type in ("", *DATABASE_TYPES),
                    "source_db_type must be mysql or postgres")
        if self.type_of_pull == "incremental":
            self._check(self.bookmark_keys, "an incremental pull needs bookmark_key")
            self._check(self.bookmark_key_order in KEY_ORDERS, "bookmark_key_order must be asc or desc")
            if self.nature_of_data == "mutable":
                self._check(self.primary_keys, "a mutable incremental table needs primary_key")
        if self.parallel_pull == "true":
            self._check(self.hash_fields, "a parallel pull needs hashfield")
            self._check(re.fullmatch(r"0*[1-9][0-9]*", self.hashpartitions.strip()),
                        "hashpartitions must be a positive integer")

    @staticmethod
    def _check(holds: object, message: str) -> None:
        if not holds:
            raise ValueError(message)

    @classmethod
    def from_row(cls, row: Row | Mapping[str, str | None]) -> TableSpec:
        """From a spec row; blanks and unknown entries (sizing, …) are ignored."""
        values = row.asDict() if isinstance(row, Row) else dict(row)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None and v.strip()})

    @property
    def primary_keys(self) -> list[str]:
        return split_columns(self.primary_key)

    @property
    def bookmark_keys(self) -> list[str]:
        return split_columns(self.bookmark_key)

    @property
    def hash_fields(self) -> list[str]:
        return split_columns(self.hashfield)

    @property
    def hash_buckets(self) -> int:
        return int(self.hashpartitions)

    @property
    def is_parallel(self) -> bool:
        return self.parallel_pull == "true"

    @property
    def partitions(self) -> list[str]:
        if self.target_partition_columns.strip() == NO_PARTITIONS:
            return []
        return split_columns(self.target_partition_columns)

    @property
    def database(self) -> str:
        return catalog_identifier(self.target_db_name)

    @property
    def table(self) -> str:
        """Without the source schema: tables of the same name from two schemas
        need a `target_table_name`."""
        return catalog_identifier(self.target_table_name or self.source_table_name)

    @property
    def source(self) -> str:
        return f"{self.source_schema_name}.{self.source_table_name}"


@dataclass(frozen=True)
class Layout:
    """Folders of one lake, all below a shared root."""

    root: str

    def _below(self, area: str, spec: TableSpec) -> str:
        return f"{self.root.rstrip('/')}/{area}/{spec.source_schema_name}/{spec.source_table_name}"

    def raw(self, spec: TableSpec, workflow: str | None = None) -> str:
        """Batches are numbered within a workflow, so each has folders of its own;
        files of other producers belong to none."""
        return self._below(f"raw/{workflow}" if workflow else "raw", spec)

    def curated(self, spec: TableSpec) -> str:
        return self._below("curated", spec)

    def bookmarks(self, spec: TableSpec, workflow: str) -> str:
        return self._below(f"bookmarks/{workflow}", spec)

    def checkpoint(self, spec: TableSpec, workflow: str) -> str:
        return self._below(f"checkpoints/{workflow}", spec)

    def state(self, spec: TableSpec) -> str:
        """Staging and load journal of the curated table."""
        return self._below("state", spec)
