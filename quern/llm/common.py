"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker turns into Python objects at a time.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch of whole texts, unless the session sets another number than Spark's own.
BATCH_ROWS, SPARKS_BATCH_ROWS = 1000, "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Where none is set a temporary one is taken on a single machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="quern-")


def few(df: DataFrame) -> DataFrame:
    """The rows in fewer partitions, two for each core or a 16th of the shuffle's at least, without
    a shuffle: for results that are much smaller than what the shuffle's number was chosen for."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))


def cut_lineage(df: DataFrame, rows: int | None = None, as_it_lies: bool = False) -> DataFrame:
    """An eager, reliable checkpoint in the shared folder, in few files (``as_it_lies``: one for each
    partition); of about ``rows`` rows, if they are known, in no more files than those need."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // 200_000)))
    return (df if as_it_lies else few(df)).checkpoint()


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows for the session: Spark bounds them by rows only, and
    10,000 whole texts may not fit in a task's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == SPARKS_BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of row ranges holding about ``max_bytes`` of text, at least one row each."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.maximum(np.cumsum(sizes) - 1, 0) // max_bytes
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    yield from zip(starts.tolist(), np.diff(np.r_[starts, len(sizes)]).tolist(), strict=True)


def annotate(
    df: DataFrame,
    text: str | Column,
    make: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]],
    new: str | T.StructType,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df[keep]`` with the columns of ``new`` computed from one text expression, by Arrow batches.

    ``make()`` runs once in each task and returns a function from a string array to the new
    columns' arrays. A kept column whose name (in any case) is also in ``new`` is replaced.
    """
    short_batches(df.sparkSession)
    schema = T._parse_datatype_string(new) if isinstance(new, str) else new
    taken = {f.name.lower() for f in schema.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    fields = [df.schema[c] for c in kept]
    out = T.StructType([*fields, *schema.fields])
    source = df.select(*[F.col(f"`{c}`") for c in kept], (F.col(f"`{text}`") if isinstance(text, str) else text).cast("string").alias("__text"))
    names, width = [f.name for f in out.fields], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(width)
            for start, length in slices(texts):
                part = batch.slice(start, length)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(width)), *work(texts.slice(start, length))], names=names)

    return source.mapInArrow(run, out)


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; nothing else changes."""
    return (text or "").encode().lower()
