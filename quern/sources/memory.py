"""Datasets from memory and from generators. Each row has a unique ordinal ``_pos``."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def parallelize(spark: SparkSession, rows: Sequence, schema: str | T.StructType, partitions: int | None = None) -> DataFrame:
    """A local sequence (of tuples, or of scalars for one column) with ``_pos``."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not isinstance(out, T.StructType):
        out = T.StructType([T.StructField("value", out)])
    whole = T.StructType([*out.fields, T.StructField("_pos", T.LongType(), False)])
    tuples = [(*(r if isinstance(r, (tuple, list)) else (r,)), i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(tuples, whole)
    return df.repartitionByRange(partitions, "_pos").sortWithinPartitions("_pos") if partitions else df


def range_of(spark: SparkSession, start: float, end: float | None = None, step: float = 1, partitions: int | None = None) -> DataFrame:
    """``value`` from start (0 if only the end is given) up to before the end, and ``_pos``.

    The step may be negative or a fraction; a range that never gets to its end is empty.
    """
    if end is None:
        start, end = 0, start
    n = max(0, math.ceil((end - start) / step))
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    whole = all(float(x).is_integer() for x in (start, step))
    value = F.col("id") * F.lit(int(step) if whole else float(step)) + F.lit(int(start) if whole else float(start))
    return ids.select(value.alias("value"), F.col("id").alias("_pos"))


def source(spark: SparkSession, n: int, expr: Callable[[Column], Column], partitions: int | None = None) -> DataFrame:
    """``value`` computed from the index by a column expression, and ``_pos``."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.select(expr(F.col("id")).alias("value"), F.col("id").alias("_pos"))


def source_udf(spark: SparkSession, n: int, make: Callable[[int], dict], schema: str | T.StructType, partitions: int | None = None) -> DataFrame:
    """Rows made from the index by an opaque function on the workers, in Arrow batches."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*out.fields, T.StructField("_pos", T.LongType())])
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([make(i) | {"_pos": i} for i in batch.column(0).to_pylist()], schema=arrow)

    return (spark.range(0, n, 1, partitions) if partitions else spark.range(n)).mapInArrow(run, whole)
