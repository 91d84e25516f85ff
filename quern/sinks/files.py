"""Sinks. All write straight to the destination with Spark's commit protocol."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import to_json


def _gzip(writer, gzip: bool):
    return writer.option("compression", "gzip") if gzip else writer


def save_json(df: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines; null fields are kept; a single column named ``value`` is written bare."""
    if df.columns == ["value"]:
        _gzip(df.select(to_json("value").alias("value")).write.mode(mode), gzip).text(path)
    else:
        _gzip(df.write.mode(mode).option("ignoreNullFields", "false"), gzip).json(path)


def csv_lines(df: DataFrame, sep: str = ";") -> DataFrame:
    """Values joined by the separator, nulls empty, nothing quoted."""
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def save_csv(df: DataFrame, path: str, sep: str = ";", header: str | bool = False, gzip: bool = False, quoted: bool = False, mode: str = "errorifexists") -> None:
    """CSV without quoting, or ``quoted`` by the usual rules. ``header`` is the column names, or a
    literal line, at the top of each file."""
    if quoted:
        return _gzip(df.write.mode(mode), gzip).csv(path, sep=sep, header=bool(header))
    lines = csv_lines(df, sep)
    if header:
        title = sep.join(df.columns) if header is True else header
        # The first line of each partition's file, without a pass of its own.
        lines = lines.mapInPandas(lambda frames: _with_title(frames, title), "value string")
    return _gzip(lines.write.mode(mode), gzip).text(path)


def _with_title(frames, title: str):
    import pandas as pd

    for i, frame in enumerate(frames):
        yield pd.concat([pd.DataFrame({"value": [title]}), frame], ignore_index=True) if i == 0 else frame


def save_parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path, compression=compression)


def stream(df: DataFrame, *order: str) -> Iterator[str]:
    """JSON lines, partition by partition, in order if one is given; never all at once."""
    column = to_json("value") if df.columns == ["value"] else F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    ordered = df.orderBy(*order) if order else df
    for row in ordered.select(column.alias("line")).toLocalIterator():
        yield row["line"]


def stream_gzip(df: DataFrame, *order: str) -> Iterator[bytes]:
    """The same as gzip members, one after another."""
    import gzip

    held: list[str] = []
    for line in stream(df, *order):
        held.append(line + "\n")
        if len(held) == 10_000:
            yield gzip.compress("".join(held).encode())
            held = []
    if held:
        yield gzip.compress("".join(held).encode())
