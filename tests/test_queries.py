"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import curated, pulls, validation
from checks.compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def generated_code(spark):
    """The other tests run interpreted; these as a cluster would."""
    changed = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


RELATIONAL = {name for module in (curated, pulls, validation) for name in module.QUERIES}


def test_every_query_has_sql():
    assert RELATIONAL <= oracle_sql().keys() <= queries().keys()


@pytest.mark.parametrize("name", sorted(RELATIONAL))
def test_query(spark, connection, name):
    assert differences(queries()[name](spark, SF_DIR), connection, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_many_partitions_go_beyond_the_old_switch(spark, monkeypatch):
    """Leading combinations of the first load; its result is compared above."""
    loaded = []
    monkeypatch.setattr(curated.Lake, "load", lambda lake, spec, batch, number: loaded.append((spec, batch)))
    monkeypatch.setattr(curated.Lake, "rows", lambda lake, spec, like=None: like)
    curated.merge_many_partitions(spark, "/root/testdata/sf0.01")
    spec, batch = loaded[0]
    month, priority, _ = spec.target_partition_columns.split(", ")
    assert batch.select(month, priority).distinct().count() > 200
