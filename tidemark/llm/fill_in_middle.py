"""Fill-in-middle: texts cut at two line ends, their parts marked and exchanged in place.

Two cuts, drawn from a digest of seed and id, part a text into prefix, middle
and suffix. The three sentinels are inserted before the parts in one byte
buffer, as they come; the order that a form wants is one exchange of two
neighbouring blocks, made by reversing each and then both together. The inverse
is the same exchange with the blocks' lengths swapped, after which the
sentinels are taken out: the text comes back to the byte.

Forms: `psm` is prefix, suffix, middle; `spm` is suffix, prefix, middle; `plain`
texts are left as they are.

Defined cases: a NULL text is empty; an empty text, one that contains a sentinel,
and one that the rate passes over are plain, with NULL for the parts' lengths; a NULL id is
drawn as an empty one; repeated rows give repeated results; long texts need a
copy of themselves and a fixed scratch; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.text_map import SLICE

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Of 100 texts: how many are rearranged, and how many of those are led by the suffix.
RATE = 100
SUFFIX_FIRST = 50
#: Bytes exchanged at a time.
SCRATCH = 1 << 16


def reverse(data: np.ndarray, start: int, end: int) -> None:
    """Reverse `data[start:end]` in place, from both ends inwards."""
    while end - start > 1:
        n = min(SCRATCH, (end - start) // 2)
        head = data[start:start + n][::-1].copy()
        data[start:start + n] = data[end - n:end][::-1]
        data[end - n:end] = head
        start, end = start + n, end - n


def exchange(data: np.ndarray, start: int, middle: int, end: int) -> None:
    """Exchange the blocks `start:middle` and `middle:end` in place."""
    reverse(data, start, middle)
    reverse(data, middle, end)
    reverse(data, start, end)


def line_ends(text: bytes) -> np.ndarray:
    """Where each line of a text ends; a last one may have no line break."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def n_chars(data: bytes | np.ndarray) -> int:
    """Code points of UTF-8."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def rearranged(text: bytes, first: int, second: int, form: str, sentinels: list[bytes]) -> bytes:
    """The text with its cuts at bytes `first <= second`, in the order of the form."""
    p, s, m = sentinels
    buffer = bytearray(text)
    buffer[second:second] = s
    buffer[first:first] = m
    buffer[:0] = p
    of_middle = len(p) + first
    of_suffix = of_middle + len(m) + second - first
    exchange(np.frombuffer(buffer, np.uint8), of_middle if form == "psm" else 0, of_suffix, len(buffer))
    return bytes(buffer)


def restored(output: bytes, form: str, sentinels: list[bytes]) -> bytes:
    """The text that `rearranged` was given."""
    if form == "plain":
        return output
    p, s, m = sentinels
    buffer = bytearray(output)
    of_suffix, of_middle = buffer.index(s), buffer.index(m)
    # In both forms the suffix block comes before what it has to follow.
    start = of_suffix if form == "psm" else 0
    after_suffix = of_middle if form == "psm" else buffer.index(p)
    exchange(np.frombuffer(buffer, np.uint8), start, after_suffix, len(buffer))
    for mark in (s, m, p):
        at = buffer.index(mark)
        del buffer[at:at + len(mark)]
    return bytes(buffer)


def checked(sentinels: tuple[str, str, str]) -> list[bytes]:
    """The sentinels as bytes; only such as no text without them can complete: all begin
    with one character that is nowhere else in them, and none begins another."""
    marks = [mark.encode() for mark in sentinels]
    lead = {mark[:1] for mark in sentinels}
    if len(lead) != 1 or any(mark.count(mark[:1]) != 1 or not mark for mark in sentinels) or any(
            i != j and b.startswith(a) for i, a in enumerate(marks) for j, b in enumerate(marks)):
        raise ValueError(f"sentinels could be taken for one another: {sentinels}")
    return marks


def _draws(id_col: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _map(rows: DataFrame, kept: list[str], schema: str, apply) -> DataFrame:
    """`kept` columns and what `apply(*columns)` returns for each row of the others, in Arrow batches."""
    names = [c for c in rows.columns if c not in kept]
    empty = rows.sparkSession.createDataFrame([], schema)
    types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [(f.name, types[f.dataType.simpleString()]) for f in empty.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = zip(*map(apply, *(part.column(c).to_pylist() for c in names)))
                arrays = [pa.array(values, type=kind) for values, (_, kind) in zip(made, fields)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays],
                                                 [*kept, *(name for name, _ in fields)])

    before = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{before}, {schema}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE,
                   suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """`id`, n (lines), form, prefix_chars, middle_chars, output of every whole text."""
    marks = checked(sentinels)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
                       *_draws(id_col, seed))

    def apply(data: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        ends = line_ends(data)
        n = len(ends)
        if not data or h3 % 100 >= rate or any(mark in data for mark in marks):
            return n, "plain", None, None, data
        cuts = [int(ends[h % (n + 1) - 1]) if h % (n + 1) else 0 for h in (h1, h2)]
        first, second = min(cuts), max(cuts)
        form = "spm" if h4 % 100 < suffix_first else "psm"
        return (n, form, n_chars(data[:first]), n_chars(data[first:second]),
                rearranged(data, first, second, form, marks))

    made = _map(rows, ["id"], "n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary", apply)
    return made.withColumn("output", F.col("output").cast("string"))


def restored_texts(rows: DataFrame, output: str = "output", form: str = "form",
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The columns of `rows` (those of `fill_in_middle`, or more) and `restored`, the text before."""
    marks = checked(sentinels)
    given = rows.select("*", F.col(output).cast("binary").alias("__output"), F.col(form).alias("__form"))
    made = _map(given, rows.columns, "restored binary", lambda data, kind: (restored(data, kind, marks),))
    return made.withColumn("restored", F.col("restored").cast("string"))
