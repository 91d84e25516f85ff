"""Operators that need no shuffle: projections, filters, one-to-many expansion."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.functions.columns import as_column
from quern.functions.scalar import truthy


def map_rows(df: DataFrame, *exprs: Column | str) -> DataFrame:
    return df.select(*exprs)


def flat_map(df: DataFrame, array: Column | str, name: str = "value", *keep: str) -> DataFrame:
    """A row for each element of the array expression; empty and null arrays give none."""
    return df.select(*keep, F.explode(as_column(array)).alias(name))


def map_values(df: DataFrame, expr: Column, value: str = "value") -> DataFrame:
    return df.withColumn(value, expr)


def flat_map_values(df: DataFrame, array: Column, key: str = "key", value: str = "value") -> DataFrame:
    return df.select(key, F.explode(array).alias(value))


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows whose condition is truthy: true, or a number other than zero."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    kind = df.select(condition.alias("c")).schema[0].dataType
    return df.where(condition if isinstance(kind, T.BooleanType) else truthy(condition))


def keys(df: DataFrame, key: str = "key") -> DataFrame:
    return df.select(key)


def values(df: DataFrame, value: str = "value") -> DataFrame:
    return df.select(value)


def _by_arrow(df: DataFrame, expand: Callable[[dict], Iterable[dict]], schema: str | T.StructType) -> DataFrame:
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                rows = [r for row in batch.slice(start, 4096).to_pylist() for r in expand(row)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, out)


def map_udf(df: DataFrame, function: Callable[[dict], dict], schema: str | T.StructType) -> DataFrame:
    """The escape hatch for opaque functions: each row as a dict, in Arrow batches."""
    return _by_arrow(df, lambda row: (function(row),), schema)


def flat_map_udf(df: DataFrame, function: Callable[[dict], Iterable[dict]], schema: str | T.StructType) -> DataFrame:
    return _by_arrow(df, function, schema)


def filter_udf(df: DataFrame, function: Callable[[dict], object]) -> DataFrame:
    return _by_arrow(df, lambda row: (row,) if function(row) else (), df.schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """An opaque function of whole Arrow batches, for those that are vectorised."""
    return df.mapInArrow(lambda batches: map(function, batches), schema)


def for_each(df: DataFrame, function: Callable[[T.Row], None]) -> None:
    """Runs a side effect on each row, on the workers."""
    df.foreach(function)
