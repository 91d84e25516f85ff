"""Small helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def same_on(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], null_safe: bool = True) -> Column:
    """Equality of the column pairs; nulls match each other unless SQL's rule is asked for."""
    terms = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs]
    return reduce(lambda x, y: x & y, terms)
