"""Sorting, and fetches by position. Positions are columns to order by; nothing is implied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quern.functions.columns import as_column


def direction(key: Column | str, ascending: bool = True, nulls_first: bool | None = None) -> Column:
    """A sort order; nulls are least unless told otherwise."""
    c = as_column(key)
    first = ascending if nulls_first is None else nulls_first
    if ascending:
        return c.asc_nulls_first() if first else c.asc_nulls_last()
    return c.desc_nulls_first() if first else c.desc_nulls_last()


def sort_by(df: DataFrame, key: Column | str, ascending: bool = True, partitions: int | None = None, nulls_first: bool | None = None) -> DataFrame:
    """Globally sorted, in both directions. ``partitions`` fixes the number of ranges."""
    order = direction(key, ascending, nulls_first)
    if partitions is None:
        return df.orderBy(order)
    return df.repartitionByRange(partitions, order).sortWithinPartitions(order)


def sort_by_key(df: DataFrame, ascending: bool = True, key: str = "key", **options) -> DataFrame:
    return sort_by(df, key, ascending, **options)


def take(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows; with an order as a bounded top-n, not a whole sort."""
    return (df.orderBy(*order) if order else df).limit(n)


def top(df: DataFrame, n: int, position: Column | str) -> DataFrame:
    """The last n rows by position, in position order."""
    return df.orderBy(as_column(position).desc()).limit(n).orderBy(as_column(position))


def top_by(df: DataFrame, n: int, key: Column | str, *ties: Column | str) -> DataFrame:
    """The n rows with the largest keys; equal keys by ``ties``, ascending."""
    return df.orderBy(direction(key, False), *ties).limit(n)


def first(df: DataFrame, *order: Column | str) -> Row | None:
    return (df.orderBy(*order) if order else df).first()


def lookup(df: DataFrame, wanted: object, key: str = "key", value: str = "value") -> DataFrame:
    """The values of a key; the filter reaches the scan."""
    return df.where(F.col(key).eqNullSafe(F.lit(wanted))).select(value)
