"""What the check queries share: a lake of their own, and the batches they load."""

from __future__ import annotations

import uuid
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.plans.curated import CuratedTable
from tidemark.plans.load import curated_table, load_batch
from tidemark.sources.jdbc import JdbcSource
from tidemark.sources.raw import land
from tidemark.spec import Layout, TableSpec
from tidemark.storage import working_folder

WORKFLOW = "wf"
# Where the relational source is, when it is not the one inside this process.
JDBC_URL_SETTING = "spark.tidemark.jdbc.url"

_loaded: set[tuple[str, str]] = set()
_loading = Lock()


class Lake:
    """A lake in a fresh shared folder, with a catalog database of its own."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self.layout = Layout(working_folder(spark, "tidemark"))
        self.database = f"tidemark_{uuid.uuid4().hex}"

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    def spec(self, table: str, **values: str) -> TableSpec:
        return TableSpec(source_schema_name="main", source_table_name=table,
                         target_db_name=self.database, **values)

    def load(self, spec: TableSpec, batch: DataFrame, batch_id: str) -> None:
        """Land a batch in raw, then load what was landed."""
        landed = land(batch, self.layout.raw(spec), batch_id)
        if landed is not None:
            load_batch(landed, spec, self.layout, load_id=batch_id)

    def curated(self, spec: TableSpec) -> CuratedTable:
        return curated_table(self.spark, spec, self.layout)

    def rows(self, spec: TableSpec, like: DataFrame | None = None) -> DataFrame:
        """The curated table; partition columns back in their source position."""
        stored = self.curated(spec).read()
        return stored.select(*like.columns) if like is not None else stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_changes(orders: DataFrame) -> DataFrame:
    """A change batch: every pending order is fulfilled, which moves it to
    another partition and leaves none behind; every urgent order is re-issued
    under a new key."""
    fulfilled = orders.filter("o_orderstatus = 'P'").withColumns(
        {"o_orderstatus": F.lit("F"), "o_totalprice": F.col("o_totalprice") + 1})
    reissued = orders.filter("o_orderpriority = '1-URGENT'").withColumns(
        {"o_orderkey": -1 - F.col("o_orderkey"), "o_orderstatus": F.lit("O")})
    return fulfilled.unionByName(reissued)


def relational(spark: SparkSession, sf_dir: str, name: str) -> JdbcSource:
    """The table `name` in a relational database, as table ``app.<name>``.

    By default an embedded one inside this process, which only local mode can
    read; a cluster names its own database in ``spark.tidemark.jdbc.url``.
    """
    url = spark.conf.get(JDBC_URL_SETTING, None)
    embedded = url is None
    if embedded:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {JDBC_URL_SETTING}: executors cannot reach an in-process database")
        label = uuid.uuid5(uuid.NAMESPACE_URL, spark.sparkContext.applicationId + sf_dir).hex
        url = f"jdbc:derby:memory:tidemark_{label};create=true"
    source = JdbcSource(url)
    with _loading:
        if embedded and (url, name) not in _loaded:
            rows = read(spark, sf_dir, name)
            texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
            longest = rows.agg(*(F.max(F.length(c)).alias(c) for c in texts)).first() if texts else None
            text = ", ".join(f"{c} VARCHAR({max(1, longest[c] or 0)})" for c in texts)
            (rows.write.mode("overwrite").option("createTableColumnTypes", text)
             .option("batchsize", 10000).jdbc(source.url, f"app.{name}", properties=source.properties))
            _loaded.add((url, name))
    return source
