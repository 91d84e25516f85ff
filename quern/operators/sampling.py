"""Random and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quern.functions.columns import as_column


def sample(df: DataFrame, with_replacement: bool, fraction: float, seed: int = 0) -> DataFrame:
    """Bernoulli draws without, Poisson draws with replacement."""
    return df.sample(with_replacement, fraction, seed)


def take_sample(df: DataFrame, with_replacement: bool, n: int, seed: int = 0) -> list[Row]:
    """Exactly n rows in random order; without replacement all rows if there are fewer."""
    if n <= 0:
        return []
    if with_replacement:
        return df.rdd.takeSample(True, n, seed) if not df.isEmpty() else []
    return df.orderBy(F.rand(seed)).limit(n).collect()


def hash_sample(df: DataFrame, key: Column | str, part: int, of: int) -> DataFrame:
    """The rows whose key falls into the first ``part`` of ``of`` md5 buckets; the same rows on
    every run, and for every table with that key."""
    bucket = F.conv(F.substring(F.md5(as_column(key).cast("string")), 1, 8), 16, 10).cast("long") % of
    return df.where(bucket < part)
