"""Set operations on whole rows; nulls equal each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import same_on


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, repeats kept (also of a dataset with itself)."""
    return a.union(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that are in both."""
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of the first that are not in the second; repeats that stay are kept."""
    right = b.toDF(*[f"__b{i}" for i in range(len(b.columns))])
    return a.join(right, same_on(a, right, list(zip(a.columns, right.columns, strict=True))), "left_anti")
