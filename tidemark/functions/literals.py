"""Typed values that leave Spark and come back as literals, without loss.

A bookmark or a partition value must be a *literal* in the next query, or it
cannot be pushed into a JDBC source or prune partitions. Passing it through a
Python ``datetime`` shifts it by the session time zone, so it travels as text
that Spark itself wrote (microseconds since the epoch for instants).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def encode(column: Column, data_type: T.DataType) -> Column:
    """The value as text, exactly recoverable by `decode`."""
    if isinstance(data_type, T.TimestampType):
        column = F.unix_micros(column)
    return column.cast("string")


def decode(text: str | None, data_type: T.DataType) -> Column:
    """A literal (or foldable expression) of type `data_type`."""
    if text is None:
        return F.lit(None).cast(data_type)
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_micros(F.lit(int(text)))
    if isinstance(data_type, T.StringType):
        return F.lit(text)
    if isinstance(data_type, T.IntegralType):
        return F.lit(int(text)).cast(data_type)
    return F.lit(text).cast(data_type)


def sql_text(text: str | None) -> str:
    """A static partition value for `PARTITION (p = …)`."""
    if text is None:
        return "null"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quote(*parts: str) -> str:
    """A back-quoted, dot-joined identifier."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)
