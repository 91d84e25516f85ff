"""Equi-joins by key. Null keys match each other unless ``null_safe`` is turned off.

``<=>`` stays an equi-join for the planner (sort-merge, shuffled hash or broadcast by size, with
adaptive skew splitting). No side is broadcast by a hint: sizes at run time decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import same_on


def _join(a: DataFrame, b: DataFrame, how: str, key: str, value: str, null_safe: bool) -> DataFrame:
    left = a.select(F.col(key).alias("__a"), F.col(value).alias("left"))
    right = b.select(F.col(key).alias("__b"), F.col(value).alias("right"))
    joined = left.join(right, same_on(left, right, [("__a", "__b")], null_safe), how)
    return joined.select(F.coalesce("__a", "__b").alias(key), "left", "right")


def join(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value", null_safe: bool = True) -> DataFrame:
    """key, left, right for every pair of values of a key."""
    return _join(a, b, "inner", key, value, null_safe)


def left_outer_join(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value", null_safe: bool = True) -> DataFrame:
    return _join(a, b, "left_outer", key, value, null_safe)


def right_outer_join(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value", null_safe: bool = True) -> DataFrame:
    return _join(a, b, "right_outer", key, value, null_safe)


def full_outer_join(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value", null_safe: bool = True) -> DataFrame:
    return _join(a, b, "full_outer", key, value, null_safe)


def co_group(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """key, lefts, rights (sorted lists, empty where a side lacks the key), in one shuffle.

    The sides are tagged and united, so one aggregation groups both: it needs a single exchange
    and no join.
    """
    tagged = a.select(F.col(key).alias(key), F.col(value).alias("__l"), F.lit(None).alias("__r"), F.lit(True).alias("__is_left"))
    tagged = tagged.unionByName(b.select(F.col(key).alias(key), F.lit(None).alias("__l"), F.col(value).alias("__r"), F.lit(False).alias("__is_left")))
    own = lambda side, column: F.transform(F.array_sort(F.collect_list(F.when(side, F.struct(F.col(column).alias("v"))))), lambda p: p["v"])
    return tagged.groupBy(key).agg(own(F.col("__is_left"), "__l").alias("lefts"), own(~F.col("__is_left"), "__r").alias("rights"))


def cartesian(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs. Columns of the second side that clash get the suffix ``_2``."""
    taken = set(a.columns)
    return a.crossJoin(b.select(*[F.col(c).alias(f"{c}_2" if c in taken else c) for c in b.columns]))


def semi_join(a: DataFrame, b: DataFrame, key: str = "key", null_safe: bool = True) -> DataFrame:
    right = b.select(F.col(key).alias("__b"))
    return a.join(right, same_on(a, right, [(key, "__b")], null_safe), "left_semi")


def anti_join(a: DataFrame, b: DataFrame, key: str = "key", null_safe: bool = True) -> DataFrame:
    right = b.select(F.col(key).alias("__b"))
    return a.join(right, same_on(a, right, [(key, "__b")], null_safe), "left_anti")
