"""Documents to mixed, encoded training data, in five stages.

Every stage reads what its predecessor kept, from a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import saved, table

STAGES = [
    ("quality", stages.keep_good_quality),
    ("near_duplicates", stages.keep_one_of_similar),
    ("secrets", stages.drop_secrets),
    ("mixing", stages.mix_sources),
    ("pieces", stages.encode_pieces),
]

#: The learned classifier and the piece codec have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
