"""The least type that holds the values of several: for batches whose schemas have drifted.

    byte < short < int < bigint < decimal < double      float < double
    date < timestamp, date < timestamp_ntz               struct, array, map: by their parts

A decimal keeps all digits before and after the point; where that takes more than 38,
and for whole numbers that meet a float, the common type is double, which
rounds. Structs have the fields of all, by name at any depth, in the order in which they
were first met. Types without a common one raise `ValueError` with the field's name: a
time without a zone and one with a zone, text and anything else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_MOST_DIGITS = 38

Fold = Callable[[str], str]


def _as_decimal(kind: T.DataType) -> T.DecimalType:
    return kind if isinstance(kind, T.DecimalType) else T.DecimalType(_DIGITS[type(kind)], 0)


def _number(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, _INTEGERS) and isinstance(b, _INTEGERS):
        return max(a, b, key=lambda kind: _DIGITS[type(kind)])
    if isinstance(a, T.FractionalType) and not isinstance(a, T.DecimalType) or \
            isinstance(b, T.FractionalType) and not isinstance(b, T.DecimalType):
        return T.DoubleType()  # two floats are equal types and do not come here
    a, b = _as_decimal(a), _as_decimal(b)
    scale = max(a.scale, b.scale)
    digits = max(a.precision - a.scale, b.precision - b.scale) + scale
    return T.DecimalType(digits, scale) if digits <= _MOST_DIGITS else T.DoubleType()


def common_type(a: T.DataType, b: T.DataType, fold: Fold = str.lower, name: str = "") -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_schema([a, b], fold, name)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType, fold, name), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType, fold, name),
                         common_type(a.valueType, b.valueType, fold, name), True)
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return _number(a, b)
    kinds = {type(a), type(b)}
    for wide in (T.TimestampType, T.TimestampNTZType):
        if kinds == {T.DateType, wide}:
            return wide()
    if all(isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) for kind in (a, b)):
        return T.StringType()
    raise ValueError(f"{name or 'a value'} is {a.simpleString()} and {b.simpleString()}, which have no common type")


def _named(schema: T.StructType, fold: Fold, name: str) -> dict[str, T.StructField]:
    fields = {fold(f.name): f for f in schema.fields}
    if len(fields) < len(schema.fields):
        raise ValueError(f"{name or 'a row'} has fields that differ in case only: {', '.join(schema.names)}")
    return fields


def common_schema(schemas: Iterable[T.StructType], fold: Fold = str.lower, name: str = "") -> T.StructType:
    """All fields of the schemas, each of the common type of those that have it."""
    def merged(a: T.StructType, b: T.StructType) -> T.StructType:
        left, right = _named(a, fold, name), _named(b, fold, name)
        fields = []
        for key, field in {**right, **left}.items():
            path = f"{name}.{field.name}".lstrip(".")
            both = key in left and key in right
            kind = common_type(left[key].dataType, right[key].dataType, fold, path) if both else field.dataType
            fields.append(T.StructField(field.name, kind, True))
        order = {key: i for i, key in enumerate([*left, *(k for k in right if k not in left)])}
        return T.StructType(sorted(fields, key=lambda f: order[fold(f.name)]))
    return reduce(merged, schemas)


def extended(stored: T.DataType, given: T.DataType, fold: Fold = str.lower, name: str = "") -> T.DataType:
    """The stored type with the fields that only `given` has, at any depth. Types of stored fields
    stay: a table's readers rely on them."""
    if isinstance(stored, T.StructType) and isinstance(given, T.StructType):
        new, known = _named(given, fold, name), _named(stored, fold, name)
        fields = [T.StructField(f.name, extended(f.dataType, new[key].dataType, fold, f"{name}.{f.name}".lstrip("."))
                                if key in new else f.dataType, f.nullable, f.metadata) for key, f in known.items()]
        return T.StructType([*fields, *(T.StructField(f.name, f.dataType, True)
                                        for key, f in new.items() if key not in known)])
    if isinstance(stored, T.ArrayType) and isinstance(given, T.ArrayType):
        return T.ArrayType(extended(stored.elementType, given.elementType, fold, name), stored.containsNull)
    if isinstance(stored, T.MapType) and isinstance(given, T.MapType):
        return T.MapType(stored.keyType, extended(stored.valueType, given.valueType, fold, name),
                         stored.valueContainsNull)
    return stored
