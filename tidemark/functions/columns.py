"""Column names: as the spec writes them, and as the data has them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.literals import quote


def fold(spark: SparkSession, name: str) -> str:
    """Equal for names that Spark takes for the same column."""
    return name if spark.conf.get("spark.sql.caseSensitive") == "true" else name.lower()


def resolve(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The names as `df` spells them; raises `ValueError` if one is missing."""
    present = {fold(df.sparkSession, c): c for c in df.columns}
    missing = [n for n in names if fold(df.sparkSession, n) not in present]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    return [present[fold(df.sparkSession, n)] for n in names]


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of `df`, also those with dots in their names."""
    return [F.col(quote(c)) for c in df.columns]


def conform(column: Column, given: T.DataType, wanted: T.DataType, name: str = "",
            folded: Callable[[str], str] = str.lower) -> Column:
    """The value as type `wanted`, fields of structs by (folded) name at any depth.

    A plain cast would take the fields of a struct by their position. Fields that the
    value lacks are NULL; fields that `wanted` lacks, and fields that are the same to
    `folded`, raise `ValueError`.
    """
    if given == wanted or given.simpleString() == wanted.simpleString():
        return column
    if isinstance(given, T.StructType) and isinstance(wanted, T.StructType):
        present = {folded(f.name): f for f in given.fields}
        if len(present) < len(given.fields):
            raise ValueError(f"{name or 'a struct'} has fields that differ in case only: {', '.join(given.names)}")
        unknown = set(present) - {folded(f.name) for f in wanted.fields}
        if unknown:
            raise ValueError(f"{name or 'a struct'} has fields that the table lacks: {', '.join(sorted(unknown))}")
        fields = []
        for field in wanted.fields:
            mine = present.get(folded(field.name))
            value = F.lit(None).cast(field.dataType) if mine is None else conform(
                column.getField(mine.name), mine.dataType, field.dataType, f"{name}.{field.name}".lstrip("."), folded)
            fields.append(value.alias(field.name))
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(given, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return F.transform(column, lambda x: conform(x, given.elementType, wanted.elementType, name, folded))
    if isinstance(given, T.MapType) and isinstance(wanted, T.MapType):
        values = F.transform_values(column, lambda _, v: conform(v, given.valueType, wanted.valueType, name, folded))
        if given.keyType == wanted.keyType:
            return values
        return F.transform_keys(values, lambda k, _: conform(k, given.keyType, wanted.keyType, name, folded))
    return column.cast(wanted)
