"""One version per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.columns import resolve
from tidemark.functions.literals import quote

_ROW, _RANK = "__row", "__rank"


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], direction: str = "asc") -> DataFrame:
    """Of all rows with one key, the last one in `order` (`desc`: the first).

    Order columns compare in turn, each in its own type, and a NULL is older than any
    value. Where they all tie, a digest of the whole row decides, so that reruns and
    other partitionings keep the same row; equal rows are one. A key with a NULL in it
    is no key: its rows all stay.

    A best row per key and task is found before the shuffle, and the shuffle moves one
    row per key and task: no window, and no task that meets all versions of a hot key.
    """
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be asc or desc")
    keys, order = resolve(df, keys), resolve(df, order)
    whole = F.struct(*(F.col(quote(c)) for c in df.columns))
    newest = direction == "asc"
    # For `desc`, the smallest is wanted, but a NULL is still the oldest.
    ranks = [part for c in order for part in (
        [F.col(quote(c))] if newest else [F.col(quote(c)).isNull(), F.col(quote(c))])]
    rank = F.struct(*(part.alias(f"r{i}") for i, part in enumerate([*ranks, F.sha2(F.to_json(whole), 256)])))
    pick = F.max_by if newest else F.min_by
    complete = reduce(and_, (F.col(quote(k)).isNotNull() for k in keys))
    missing = reduce(or_, (F.col(quote(k)).isNull() for k in keys))
    best = (df.filter(complete).select(*(F.col(quote(k)).alias(f"__k{i}") for i, k in enumerate(keys)),
                                       whole.alias(_ROW), rank.alias(_RANK))
            .groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(pick(_ROW, _RANK).alias(_ROW)))
    one = best.select(*(F.col(_ROW).getField(c).alias(c) for c in df.columns))
    if not any(df.schema[k].nullable for k in keys):
        return one
    return one.unionAll(df.filter(missing))
