import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       # Names that operators use for their own results.
                       T.StructField("id", T.StringType()), T.StructField("size", T.StringType()),
                       T.StructField("score", T.StringType()), T.StructField("row", T.StringType()),
                       T.StructField("component", T.StringType()), T.StructField("taken", T.StringType())])


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text[, source]) rows, with extra columns of clashing names."""
    def make(*rows):
        full = [(i, text, "en", rest[0] if rest else "a", None if text is None else len(text),
                 "x", "x", "x", "x", "x", "x") for i, text, *rest in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture
def odd_documents(documents):
    """NULLs in every place, empty and long texts, repeated rows and copies."""
    words = " ".join(f"word{i % 700}x{i % 13}" for i in range(30_000))
    return documents((1, "one two three four five six seven"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "),
                     (None, "no id at all in this row here"), (5, "one two three four five six seven"),
                     (1, "one two three four five six seven"), (6, "NUL \x00 and \u00a0 é 漢 \U0001d538 ▁ text", None),
                     (7, words), (8, words[:-4]), (9, "x" * 50_000), (None, None, None))
