"""Merge algebra: DataFrame in, DataFrame out, no table is written here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from tidemark.functions.columns import columns_of
from tidemark.functions.literals import decode, encode, quote

IN_BATCH = "in_batch"

#: Key values that a scan is asked for one by one, and ranges beyond that.
MOST_VALUES, KEY_GROUPS = 200, 32

_RANGE_TYPES = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def batch_keys(batch: DataFrame, primary_key: Sequence[str],
               partitions: Sequence[str] = ()) -> DataFrame:
    """Distinct keys of a batch with the partitions they now belong to.

    The distinct is combined before its shuffle, so a key that holds a large
    share of the batch arrives as one row per task, not as all its copies.
    """
    columns = list(dict.fromkeys([*primary_key, *partitions]))
    return batch.select(*columns).distinct()


def key_range(keys: DataFrame, primary_key: Sequence[str]) -> Column | None:
    """`min <= k <= max` per key column, as literals that reach the scan.

    Lets parquet skip row groups (and JDBC skip pages) without the batch's
    keys. One aggregate over the keys; None if no key column is orderable.
    """
    types = {f.name: f.dataType for f in keys.schema.fields}
    columns = [k for k in primary_key if isinstance(types[k], _RANGE_TYPES)]
    if not columns:
        return None
    bounds = keys.agg(*(
        encode(pick(k), types[k]).alias(f"{name}_{i}")
        for i, k in enumerate(columns) for name, pick in (("lo", F.min), ("hi", F.max))
    )).first()
    return reduce(and_, [
        F.col(k).between(decode(bounds[f"lo_{i}"], types[k]), decode(bounds[f"hi_{i}"], types[k]))
        for i, k in enumerate(columns)
    ])


def key_filter(keys: DataFrame, primary_key: Sequence[str], most: int = MOST_VALUES,
               groups: int = KEY_GROUPS) -> Column | None:
    """A condition on each key column that all keys of the batch meet, as literals that reach the scan.

    At most `most` different values are named; more are covered by the ranges of up to
    `groups` groups of neighbours, so that keys from far apart do not open what lies
    between them. In files that are sorted by key, only the pages (and by
    their Bloom filters only the row groups) that can hold a key are then read. One pass over the
    keys measures them, another names values or ranges; both results are bounded.
    """
    types = {f.name: f.dataType for f in keys.schema.fields}
    columns = [k for k in primary_key if isinstance(types[k], _RANGE_TYPES)]
    if not columns:
        return None
    ranked = [k for k in columns if not isinstance(types[k], T.StringType)]
    cuts = [F.percentile_approx(quote(k), [i / groups for i in range(1, groups)]).alias(f"cuts_{columns.index(k)}")
            for k in ranked]
    measured = keys.agg(*(F.approx_count_distinct(quote(k), 0.02).alias(f"n_{i}") for i, k in enumerate(columns)), *cuts)
    sizes = measured.select(*(f"n_{i}" for i in range(len(columns)))).first()
    conditions = []
    for i, k in enumerate(columns):
        column, text = F.col(quote(k)), encode(F.col(quote(k)), types[k])
        if sizes[f"n_{i}"] <= most:
            values = [row[0] for row in keys.filter(column.isNotNull()).select(text).distinct().collect()]
            conditions.append(column.isin([decode(v, types[k]) for v in sorted(values)]) if values else F.lit(False))
        elif k not in ranked:
            conditions.append(key_range(keys, [k]))
        else:
            group = F.expr(f"size(filter(cuts_{i}, c -> c < {quote(k)}))")
            ranges = (keys.filter(column.isNotNull()).crossJoin(F.broadcast(measured.select(f"cuts_{i}")))  # one row
                      .groupBy(group.alias("group")).agg(F.min(quote(k)).alias("lo"), F.max(quote(k)).alias("hi")))
            spans = ranges.select(*(encode(F.col(c), types[k]).alias(c) for c in ("lo", "hi"))).collect()
            conditions.append(reduce(or_, (column.between(decode(r["lo"], types[k]), decode(r["hi"], types[k]))
                                           for r in sorted(spans))))
    return reduce(and_, conditions)


def matched_key_partitions(target: DataFrame, keys: DataFrame, primary_key: Sequence[str],
                           partitions: Sequence[str]) -> DataFrame:
    """Key and *stored* partition of every target row that the batch touches.

    A semi-join, so the batch's partition values cannot be mistaken for the
    stored ones and copies on either side do not multiply. The batch side keeps
    its copies out by `batch_keys`; a hot key in the target is on the side that
    adaptive execution can split. The join strategy is left to the optimizer,
    which sees the size of `keys`.
    """
    columns = list(dict.fromkeys([*primary_key, *partitions]))
    matched = target.select(*columns).join(keys.select(*primary_key), list(primary_key), "left_semi")
    return matched.select(*columns)


def affected_partitions(target: DataFrame, keys: DataFrame, primary_key: Sequence[str],
                        partitions: Sequence[str]) -> DataFrame:
    """Partitions a merge must rewrite: those in the batch, and those its keys leave.

    One row per partition; `in_batch` says whether the batch has rows for it.
    Without such rows a partition may be left with none at all.
    """
    stored = matched_key_partitions(target, keys, primary_key, partitions).select(*partitions)
    both = keys.select(*partitions, F.lit(True).alias(IN_BATCH)).unionByName(
        stored.withColumn(IN_BATCH, F.lit(False)))
    return both.groupBy(*partitions).agg(F.max(IN_BATCH).alias(IN_BATCH))


def upsert(target: DataFrame, batch: DataFrame, primary_key: Sequence[str],
           keys: DataFrame | None = None) -> DataFrame:
    """Stored rows whose key is not in the batch, and every row of the batch.

    Copies are kept on both sides; a NULL key matches nothing. Columns that one
    side lacks read as NULL.
    """
    keys = batch if keys is None else keys
    kept = target.join(keys.select(*primary_key), list(primary_key), "left_anti")
    return kept.select(*columns_of(target)).unionByName(batch, allowMissingColumns=True)


def encode_partitions(df: DataFrame, partitions: Sequence[str], *others: str) -> DataFrame:
    """The partition columns as text, for a trip to the driver or to disk."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*(encode(F.col(p), types[p]).alias(p) for p in partitions), *others)


def partition_predicate(values: Sequence[Row], schema: T.StructType,
                        partitions: Sequence[str]) -> Column:
    """Whether a row is in one of the given partitions.

    `values` are encoded (`encode_partitions`). The set is written as a tree over the
    columns, equal subtrees once: conditions `p IN (…)` on the columns themselves, joined by
    AND and OR. That is exact for every combination, a catalog can filter its list
    of partitions by it, and it is decided before any file is listed or read.
    """
    types = {f.name: f.dataType for f in schema.fields}
    tuples = {tuple(v[p] for p in partitions) for v in values}
    if not tuples:
        return F.lit(False)
    return _among(tuples, list(partitions), types)


def _among(tuples: set[tuple], partitions: list[str], types: Mapping[str, T.DataType]) -> Column:
    """The tuples as conditions on the columns; the first column's values that go with the same
    further ones share a condition. As deep as there are columns, whatever the number of tuples."""
    name, rest = partitions[0], partitions[1:]
    if not rest:
        return _in({t[0] for t in tuples}, name, types[name])
    followed: dict[str | None, set[tuple]] = {}
    for value, *others in tuples:
        followed.setdefault(value, set()).add(tuple(others))
    alike: dict[frozenset, set] = {}
    for value, others in followed.items():
        alike.setdefault(frozenset(others), set()).add(value)
    branches = [_in(held, name, types[name]) & _among(set(others), rest, types)
                for others, held in sorted(alike.items(), key=lambda item: sorted(map(str, item[1])))]
    while len(branches) > 1:  # in pairs, so that the expression stays shallow
        branches = [reduce(or_, branches[i:i + 2]) for i in range(0, len(branches), 2)]
    return branches[0]


def _in(values: set[str | None], name: str, data_type: T.DataType) -> Column:
    column = F.col(quote(name))
    texts = sorted(v for v in values if v is not None)
    known = column.isin([decode(v, data_type) for v in texts]) if texts else None
    if None not in values:
        return known
    return column.isNull() if known is None else column.isNull() | known


def restrict_to_partitions(df: DataFrame, values: Sequence[Row],
                           partitions: Sequence[str]) -> DataFrame:
    """The rows of `df` in the given (encoded) partitions, read from those only."""
    if not values:
        return df.filter(F.lit(False))
    return df.filter(partition_predicate(values, df.schema, partitions))
