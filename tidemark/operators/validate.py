"""Rule-based validation report over any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.rules import Rule


def validate(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule],
             errors: str = "errors") -> DataFrame:
    """The failing rows: their `keys` and all their messages, comma-joined.

    One narrow pass without a shuffle; only columns that keys and rules name
    are read. Every violated rule is reported, whatever the others say.
    """
    messages = [F.when(rule.violated, F.lit(rule.message)) for rule in rules]
    reported = df.select(*keys, F.concat_ws(", ", *messages).alias(errors))
    return reported.filter(F.col(errors) != "")


def passed(report: DataFrame) -> DataFrame:
    """One row, `passed`: whether the report is empty."""
    return report.limit(1).agg((F.count(F.lit(1)) == 0).alias("passed"))


def require_clean(report: DataFrame) -> None:
    """Gate: raise if the report has any row (stops at the first one found)."""
    if not report.isEmpty():
        raise ValueError("validation failed, see the report")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("sep", "|").option("header", True).csv(path)
