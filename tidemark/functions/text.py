"""Text helpers shared by table specs and specs held in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def split_columns(text: str | None) -> list[str]:
    """``"a, b"`` → ``["a", "b"]``: blanks removed, empty entries dropped."""
    return [name for name in (text or "").replace(" ", "").split(",") if name]


def split_columns_of(column: Column | str) -> Column:
    """`split_columns` for a whole column of comma-separated lists."""
    column = F.col(column) if isinstance(column, str) else column
    without_blanks = F.regexp_replace(F.coalesce(column, F.lit("")), " ", "")
    return F.array_remove(F.split(without_blanks, ","), "")


def is_blank(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.isNull() | (F.trim(column) == "")


def identifier(*parts: Column | str) -> Column:
    """``workflow|schema|table``; plain strings are taken as literals."""
    return F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts))
