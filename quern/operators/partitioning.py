"""Partitioners and persistence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import as_column


@dataclass(frozen=True)
class HashPartitioner:
    partitions: int

    def place(self, df: DataFrame, key: Column | str) -> DataFrame:
        return df.repartition(self.partitions, as_column(key))


@dataclass(frozen=True)
class RangePartitioner:
    """Ranges of a key, of about equal size by a sample."""

    partitions: int

    def place(self, df: DataFrame, key: Column | str) -> DataFrame:
        return df.repartitionByRange(self.partitions, as_column(key))


@dataclass(frozen=True)
class CustomPartitioner:
    """A key column to the partition's number, as a column expression."""

    partitions: int
    index: Callable[[Column], Column]

    def place(self, df: DataFrame, key: Column | str) -> DataFrame:
        number = F.pmod(self.index(as_column(key)).cast("int"), F.lit(self.partitions))
        return df.repartitionById(self.partitions, number)


def partition_by(df: DataFrame, partitioner: HashPartitioner | RangePartitioner | CustomPartitioner, key: Column | str = "key") -> DataFrame:
    return partitioner.place(df, key)


def persist(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    return df.persist(level)


def unpersist(df: DataFrame) -> DataFrame:
    return df.unpersist()
