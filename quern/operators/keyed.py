"""Aggregations, whole and by key. All combine on the map side before the shuffle."""

from __future__ import annotations

import copy
import functools
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.functions.columns import as_column

#: Reducers by name, for ``reduce`` and ``reduce_by_key``.
REDUCERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg, "product": F.product, "and": F.bool_and, "or": F.bool_or}


def _reducer(how: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    return REDUCERS[how] if isinstance(how, str) else how


def aggregate(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row of aggregates over all rows."""
    return df.agg(*aggregates)


#: Keys whose states a task holds before it hands them on.
HELD_KEYS = 50_000


def aggregate_udf(df: DataFrame, init: object, reducer: Callable, combiner: Callable) -> object:
    """A fold by opaque functions; ``init`` must be neutral. Each partition folds its rows, in Arrow
    batches, to one state; states are combined in partition order."""
    row = Row(*df.columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = copy.deepcopy(init)
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = reducer(state, row(*values))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    states = df.mapInArrow(fold, "state binary").toLocalIterator()
    return functools.reduce(combiner, (pickle.loads(r["state"]) for r in states), copy.deepcopy(init))


def reduce(df: DataFrame, value: Column | str = "value", how: str | Callable[[Column], Column] = "sum") -> DataFrame:
    return df.agg(_reducer(how)(as_column(value)).alias("value"))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def aggregate_by_key(df: DataFrame, *aggregates: Column, key: str | list[str] = "key") -> DataFrame:
    """Several accumulators by key in one pass. Null keys are a group of their own."""
    if not aggregates:
        raise ValueError("no aggregate given")
    return df.groupBy(*([key] if isinstance(key, str) else key)).agg(*aggregates)


def reduce_by_key(df: DataFrame, how: str | Callable[[Column], Column] = "sum", key: str = "key", value: str = "value") -> DataFrame:
    return df.groupBy(key).agg(_reducer(how)(F.col(value)).alias(value))


def aggregate_by_key_udf(df: DataFrame, init: object, reducer: Callable, combiner: Callable, schema: str | T.StructType, key: str = "key", value: str = "value") -> DataFrame:
    """By-key fold by opaque functions. Tasks fold their rows to a state a key, in Arrow batches and
    for at most ``HELD_KEYS`` keys at a time; states are shuffled by key and combined as they come."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow, key_type = to_arrow_schema(out), df.schema[key].dataType.simpleString()
    key_arrow = to_arrow_schema(df.select(key).schema).field(0).type

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(states), key_arrow), pa.array([pickle.dumps(x) for x in states.values()], pa.binary())], names=["key", "state"])

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                states[k] = reducer(states[k] if k in states else copy.deepcopy(init), v)
            if len(states) > HELD_KEYS:
                yield told()
                states.clear()
        yield told()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state, begun = None, None, False
        for batch in batches:
            done = []
            for k, pickled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if begun and k == open_key:
                    state = combiner(state, pickle.loads(pickled))
                    continue
                if begun:
                    done.append((open_key, state))
                open_key, state, begun = k, pickle.loads(pickled), True
            yield told(done)
        if begun:
            yield told([(open_key, state)])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)

    partial = df.select(F.col(key).alias("key"), F.col(value).alias("value")).mapInArrow(fold, f"key {key_type}, state binary")
    return partial.repartition("key").sortWithinPartitions("key").mapInArrow(merge, out)


def group_by_key(df: DataFrame, key: str = "key", value: str = "value", order: str | None = None) -> DataFrame:
    """All values of each key, sorted by ``order`` (default: by the value itself)."""
    if order is None:
        return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(value))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(pairs, lambda p: p["v"]).alias(value))


def count_by_key(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def count_by_value(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("count"))


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()
