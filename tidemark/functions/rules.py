"""Row rules: each one is a message and a condition that is true on violation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tidemark.functions.text import is_blank


@dataclass(frozen=True)
class Rule:
    message: str
    violated: Column


def allowed(column: str, values: Sequence[object], message: str | None = None) -> Rule:
    """The value must be one of `values`; a missing value is not."""
    inside = F.coalesce(F.col(column).isin(*values), F.lit(False))
    listed = ", ".join(str(v) for v in values)
    return Rule(message or f"{column} must be one of: {listed}", ~inside)


def not_blank(column: str, message: str | None = None) -> Rule:
    return Rule(message or f"{column} must not be blank", is_blank(column))


def positive(column: str, message: str | None = None) -> Rule:
    """The text must be a number above zero; missing counts as zero."""
    number = F.coalesce(F.expr(f"try_cast(`{column}` AS DOUBLE)"), F.lit(0.0))
    return Rule(message or f"{column} must be a number above 0", number <= 0)


def violation(condition: Column, message: str) -> Rule:
    """A free-form rule: `condition` is true on a bad row, NULL counts as good."""
    return Rule(message, F.coalesce(condition, F.lit(False)))


def requires(when: Column, then: Column, message: str) -> Rule:
    """If `when` holds, `then` must hold too; an unknown `then` does not."""
    holds = F.coalesce(then, F.lit(False))
    return Rule(message, F.coalesce(when, F.lit(False)) & ~holds)
