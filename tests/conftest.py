import sys
import uuid
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.plans.load import curated_table, load_batch  # noqa: E402
from tidemark.spec import Layout, TableSpec  # noqa: E402
from tidemark.storage import working_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "2").config("spark.default.parallelism", "2")
               # Tiny inputs: compiling a plan takes longer than running it.
               .config("spark.sql.codegen.wholeStage", "false")
               .config("spark.sql.codegen.factoryMode", "NO_CODEGEN").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Lake:
    """A fresh lake with one table `t`."""

    def __init__(self, spark):
        self.spark = spark
        self.layout = Layout(working_folder(spark, "test"))
        self.database = f"test_{uuid.uuid4().hex}"

    def spec(self, **values):
        values.setdefault("source_table_name", "t")
        return TableSpec(source_schema_name="s", target_db_name=self.database, **values)

    def mutable(self, partitions="None", key="id", **values):
        return self.spec(type_of_pull="incremental", bookmark_key="id", bookmark_key_order="asc",
                         primary_key=key, target_partition_columns=partitions, **values)

    def load(self, spec, batch, load_id=None):
        return load_batch(batch, spec, self.layout, load_id)

    def table(self, spec):
        return curated_table(self.spark, spec, self.layout)

    def rows(self, spec, *columns):
        table = self.table(spec)
        self.spark.catalog.refreshTable(table.name)  # the load may have run in another session
        df = table.read()
        return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)

    def files(self, spec):
        root = Path(self.layout.curated(spec).removeprefix("file:"))
        return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


@pytest.fixture
def lake(spark):
    return Lake(spark)
