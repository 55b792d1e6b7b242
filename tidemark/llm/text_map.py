"""Apply a Python function to whole texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Texts handed over at a time, so that what a function makes of them stays small.
SLICE = 500


def map_texts(docs: DataFrame, id_col: str, text: str, start: Callable[[], Callable[[list], dict]],
              schema: str, kind: str = "string", carry: bool = False) -> DataFrame:
    """`id` and what `start()(texts)` returns for each batch, a list per column.

    `start` runs once a task, so that a task can keep tables and caches. `schema`
    names the columns after `id`. Texts arrive whole; NULL arrives as None. With
    `carry`, the struct `row` has all columns of the input.
    """
    columns = [F.col(id_col).alias("id"), F.col(text).cast(kind).alias("text")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = docs.select(*columns)
    empty = docs.sparkSession.createDataFrame([], schema)
    names = empty.columns
    types = {f.name: to_arrow_type(f.dataType) for f in empty.schema.fields}
    kept = ["id", "row"] if carry else ["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = apply(part.column("text").to_pylist())
                arrays = [pa.array(found[n], type=types[n]) for n in names]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], [*kept, *names])

    before = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{before}, {schema}")
