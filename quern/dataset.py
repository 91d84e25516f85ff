"""A fluent dataset: a DataFrame with a key/value convention and an explicit order.

Rows are typed; a keyed dataset has the columns ``key`` and ``value``. Positions are explicit:
an ordered dataset carries hidden columns that narrow operators keep, wide ones drop and sorting
puts a key in front of. As long as the partitions themselves lie in that order (sources, narrow
operators, unions) no action sorts: rows are taken, streamed and saved as they lie. Nothing runs
before an action.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import session
from quern.functions.columns import as_column
from quern.operators import joins, keyed, narrow, ordering, partitioning, sampling, sets
from quern.sinks import files as sinks
from quern.sources import files, memory, streams

HIDDEN = "__ord"


class Context:
    """Makes datasets in a session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def parallelize(self, rows: Sequence, schema: str | T.StructType, partitions: int | None = None) -> Dataset:
        return Dataset._positioned(memory.parallelize(self.spark, rows, schema, partitions))

    def range(self, start: float, end: float | None = None, step: float = 1, partitions: int | None = None) -> Dataset:
        return Dataset._positioned(memory.range_of(self.spark, start, end, step, partitions))

    def source(self, n: int, expr: Callable[[Column], Column], partitions: int | None = None) -> Dataset:
        return Dataset._positioned(memory.source(self.spark, n, expr, partitions))

    def source_udf(self, n: int, make: Callable[[int], dict], schema: str, partitions: int | None = None) -> Dataset:
        return Dataset._positioned(memory.source_udf(self.spark, n, make, schema, partitions))

    def text_file(self, path: str, max_files: int | None = None, parquet: bool = False) -> Dataset:
        """Lines in order of the files' names. Spark packs splits by size, so an action that needs
        the order sorts by it."""
        if parquet or path.endswith(".parquet"):
            return Dataset(files.text_file(self.spark, path, max_files, parquet))
        lines = files.text_file(self.spark, path, max_files, positions=True)
        return Dataset(lines.select("value", F.col("_file").alias(f"{HIDDEN}0"), F.col("_pos").alias(f"{HIDDEN}1")), (True, True), False)

    def json_file(self, path: str, schema: str | T.StructType) -> Dataset:
        return Dataset(files.json_file(self.spark, path, schema))

    def csv_file(self, path: str, schema: str | T.StructType, sep: str = ",", header: bool = False) -> Dataset:
        return Dataset(files.csv_file(self.spark, path, schema, sep, header))

    def jdbc(self, url: str, table: str, **options: str) -> Dataset:
        return Dataset(files.jdbc(self.spark, url, table, **options))

    def require(self, *paths: str) -> None:
        """Ships Python modules (files, packages as zip) to the workers."""
        session.require(self.spark, *paths)

    @property
    def env(self) -> dict[str, str]:
        """What ``get_session(env=...)`` has set on the workers."""
        prefix = "spark.executorEnv."
        return {k.removeprefix(prefix): v for k, v in self.spark.sparkContext.getConf().getAll() if k.startswith(prefix)}

    def line_stream(self, stream) -> Dataset:
        return Dataset(streams.line_stream(self.spark, stream))

    def object_stream(self, objects, schema: str) -> Dataset:
        return Dataset(streams.object_stream(self.spark, objects, schema))

    def dataset(self, df: DataFrame, position: str | None = None) -> Dataset:
        return Dataset._positioned(df.withColumnRenamed(position, "_pos")) if position else Dataset(df)

    def end(self) -> None:
        self.spark.stop()


class Dataset:
    def __init__(self, df: DataFrame, directions: tuple[bool | tuple[bool, bool], ...] = (), natural: bool = True):
        """``directions``: of each hidden order column, whether it ascends, or that and whether nulls
        come first. ``natural``: whether the rows lie in that order, partition by partition."""
        self.hidden_df, self.directions, self.natural = df, directions, natural

    @classmethod
    def _positioned(cls, df: DataFrame) -> Dataset:
        return cls(df.withColumn(f"{HIDDEN}0", F.array(F.col("_pos").cast("long"))).drop("_pos"), (True,))

    @property
    def _hidden(self) -> list[str]:
        return [f"{HIDDEN}{i}" for i in range(len(self.directions))]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.hidden_df.columns if not c.startswith(HIDDEN)]

    @property
    def df(self) -> DataFrame:
        """The rows without order."""
        return self.hidden_df.select(*[F.col(f"`{c}`") for c in self.columns])

    def _order(self, reverse: bool = False) -> list[Column]:
        out = []
        for c, how in zip(self._hidden, self.directions, strict=True):
            up, first = how if isinstance(how, tuple) else (how, how)
            out.append(ordering.direction(c, up != reverse, first != reverse))
        return out

    def ordered(self) -> DataFrame:
        rows = self.hidden_df if self.natural else self.hidden_df.orderBy(*self._order())
        return rows.select(*[F.col(f"`{c}`") for c in self.columns])

    def _narrow(self, *exprs: Column | str) -> Dataset:
        return Dataset(self.hidden_df.select(*exprs, *self._hidden), self.directions, self.natural)

    def _wide(self, df: DataFrame) -> Dataset:
        return Dataset(df)

    # Narrow transformations

    def map(self, *exprs: Column | str) -> Dataset:
        return self._narrow(*exprs)

    def map_udf(self, function: Callable[[dict], dict], schema: str) -> Dataset:
        return self._wide(narrow.map_udf(self.df, function, schema))

    def flat_map(self, array: Column | str, name: str = "value", *keep: str) -> Dataset:
        c = as_column(array)
        if not self.directions:
            return self._wide(narrow.flat_map(self.df, c, name, *keep))
        rows = self.hidden_df.select(*keep, *self._hidden, F.posexplode(c).alias("__i", name))
        last = self._hidden[-1]
        return Dataset(rows.withColumn(last, F.concat(last, F.array(F.col("__i").cast("long")))).select(*keep, name, *self._hidden), self.directions, self.natural)

    def map_values(self, expr: Column) -> Dataset:
        return self._narrow("key", expr.alias("value"))

    def flat_map_values(self, array: Column) -> Dataset:
        return self.flat_map(array, "value", "key")

    def filter(self, condition: Column | str) -> Dataset:
        return Dataset(narrow.filter_rows(self.hidden_df, condition), self.directions, self.natural)

    def filter_udf(self, function: Callable[[dict], object]) -> Dataset:
        return self._wide(narrow.filter_udf(self.df, function))

    def flat_map_udf(self, function: Callable[[dict], Iterable[dict]], schema: str) -> Dataset:
        return self._wide(narrow.flat_map_udf(self.df, function, schema))

    def map_batches(self, function: Callable, schema: str) -> Dataset:
        return self._wide(narrow.map_batches(self.df, function, schema))

    def keys(self) -> Dataset:
        return self._narrow("key")

    def values(self) -> Dataset:
        return self._narrow("value")

    def sample(self, with_replacement: bool, fraction: float, seed: int = 0) -> Dataset:
        return Dataset(sampling.sample(self.hidden_df, with_replacement, fraction, seed), self.directions, self.natural)

    def hash_sample(self, key: Column | str, part: int, of: int) -> Dataset:
        return Dataset(sampling.hash_sample(self.hidden_df, key, part, of), self.directions, self.natural)

    def union(self, other: Dataset) -> Dataset:
        """The rows of this one, then those of the other; ordered if both are in the same way."""
        if not self.directions or self.directions != other.directions:
            return self._wide(sets.union(self.df, other.df))
        if self.directions != (True,):
            sided = lambda d, i: d.hidden_df.select(*[F.col(f"`{c}`") for c in d.columns], F.lit(i).alias(f"{HIDDEN}0"), *[F.col(c).alias(f"{HIDDEN}{j + 1}") for j, c in enumerate(d._hidden)])
            return Dataset(sided(self, 0).union(sided(other, 1)), (True, *self.directions), self.natural and other.natural)
        side = lambda d, i: d.hidden_df.withColumn(f"{HIDDEN}0", F.concat(F.array(F.lit(i).cast("long")), f"{HIDDEN}0"))
        return Dataset(side(self, 0).union(side(other, 1)), (True,), self.natural and other.natural)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Dataset:
        return Dataset(partitioning.persist(self.hidden_df, level), self.directions, self.natural)

    def unpersist(self) -> Dataset:
        self.hidden_df.unpersist()
        return self

    # Wide transformations

    def aggregate_by_key(self, *aggregates: Column) -> Dataset:
        return self._wide(keyed.aggregate_by_key(self.df, *aggregates))

    def aggregate_by_key_udf(self, init: object, reducer: Callable, combiner: Callable, schema: str) -> Dataset:
        return self._wide(keyed.aggregate_by_key_udf(self.df, init, reducer, combiner, schema))

    def reduce_by_key(self, how: str | Callable[[Column], Column] = "sum") -> Dataset:
        return self._wide(keyed.reduce_by_key(self.df, how))

    def group_by_key(self) -> Dataset:
        order = self._hidden[0] if self.directions == (True,) else None
        return self._wide(keyed.group_by_key(self.hidden_df, order=order))

    def co_group(self, other: Dataset) -> Dataset:
        return self._wide(joins.co_group(self.df, other.df))

    def join(self, other: Dataset) -> Dataset:
        return self._wide(joins.join(self.df, other.df))

    def left_outer_join(self, other: Dataset) -> Dataset:
        return self._wide(joins.left_outer_join(self.df, other.df))

    def right_outer_join(self, other: Dataset) -> Dataset:
        return self._wide(joins.right_outer_join(self.df, other.df))

    def full_outer_join(self, other: Dataset) -> Dataset:
        return self._wide(joins.full_outer_join(self.df, other.df))

    def semi_join(self, other: Dataset) -> Dataset:
        return self._wide(joins.semi_join(self.df, other.df))

    def anti_join(self, other: Dataset) -> Dataset:
        return self._wide(joins.anti_join(self.df, other.df))

    def cartesian(self, other: Dataset) -> Dataset:
        return self._wide(joins.cartesian(self.df, other.df))

    def distinct(self) -> Dataset:
        return self._wide(keyed.distinct(self.df))

    def intersection(self, other: Dataset) -> Dataset:
        return self._wide(sets.intersection(self.df, other.df))

    def subtract(self, other: Dataset) -> Dataset:
        return self._wide(sets.subtract(self.df, other.df))

    def sort_by(self, key: Column | str, ascending: bool = True, partitions: int | None = None, nulls_first: bool | None = None) -> Dataset:
        """A key in front of the order at hand; equal keys keep it. Sorted once, by the action; or at
        once, into so many ranges, if ``partitions`` are given. Nulls are least unless told otherwise."""
        shifted = [F.col(c).alias(f"{HIDDEN}{i + 1}") for i, c in enumerate(self._hidden)]
        rows = self.hidden_df.select(*[F.col(f"`{c}`") for c in self.columns], as_column(key).alias(f"{HIDDEN}0"), *shifted)
        out = Dataset(rows, (ascending if nulls_first is None else (ascending, nulls_first), *self.directions), False)
        if partitions is None:
            return out
        return Dataset(rows.repartitionByRange(partitions, *out._order()).sortWithinPartitions(*out._order()), out.directions)

    def sort_by_key(self, ascending: bool = True, partitions: int | None = None, nulls_first: bool | None = None) -> Dataset:
        return self.sort_by("key", ascending, partitions, nulls_first)

    def partition_by(self, partitioner: partitioning.HashPartitioner | partitioning.RangePartitioner | partitioning.CustomPartitioner, key: Column | str = "key") -> Dataset:
        return Dataset(partitioning.partition_by(self.hidden_df, partitioner, key), self.directions, not self.directions)

    # Actions

    def collect(self) -> list[Row]:
        return self.ordered().collect()

    def count(self) -> int:
        return self.df.count()

    def aggregate(self, *aggregates: Column) -> Row:
        return keyed.aggregate(self.df, *aggregates).first()

    def aggregate_udf(self, init: object, reducer: Callable, combiner: Callable) -> object:
        return keyed.aggregate_udf(self.df, init, reducer, combiner)

    def reduce(self, how: str | Callable[[Column], Column] = "sum", value: Column | str = "value") -> object:
        return keyed.reduce(self.df, value, how).first()[0]

    def count_by_key(self) -> dict:
        return {r["key"]: r["count"] for r in keyed.count_by_key(self.df).collect()}

    def count_by_value(self) -> list[tuple[tuple, int]]:
        return [(tuple(r[:-1]), r["count"]) for r in keyed.count_by_value(self.df).collect()]

    def take(self, n: int) -> list[Row]:
        """The first n rows; as they lie it reads no more partitions than it needs."""
        if self.natural:
            return self.df.limit(n).collect()
        return Dataset(self.hidden_df.orderBy(*self._order()).limit(n), self.directions, False).collect()

    def first(self) -> Row | None:
        return next(iter(self.take(1)), None)

    def top(self, n: int) -> list[Row]:
        """The last n rows, in order."""
        if self.natural:
            return self.df.tail(n)
        return Dataset(self.hidden_df.orderBy(*self._order(reverse=True)).limit(n), self.directions, False).collect()

    def top_by(self, n: int, key: Column | str, *ties: Column | str) -> list[Row]:
        """The n rows with the largest keys, largest first."""
        return ordering.top_by(self.df, n, key, *ties).collect()

    def take_sample(self, with_replacement: bool, n: int, seed: int = 0) -> list[Row]:
        return sampling.take_sample(self.df, with_replacement, n, seed)

    def lookup(self, key: object) -> list:
        return [r[0] for r in self.filter(F.col("key").eqNullSafe(F.lit(key))).values().collect()]

    def for_each(self, function: Callable[[Row], None]) -> None:
        narrow.for_each(self.df, function)

    def save(self, path: str, csv: dict | bool | None = None, parquet: dict | bool | None = None, gzip: bool = False, mode: str = "errorifexists") -> None:
        """JSON lines, or CSV with ``csv={"sep", "header"}``, or ``parquet={"compression"}``."""
        rows = self.ordered()
        if csv:
            sinks.save_csv(rows, path, gzip=gzip, mode=mode, **(csv if isinstance(csv, dict) else {}))
        elif parquet:
            sinks.save_parquet(rows, path, mode=mode, **(parquet if isinstance(parquet, dict) else {}))
        else:
            sinks.save_json(rows, path, gzip=gzip, mode=mode)

    def stream(self, gzip: bool = False) -> Iterator:
        return (sinks.stream_gzip if gzip else sinks.stream)(self.ordered())
