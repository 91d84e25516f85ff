"""Finite streams as datasets: a readable is spooled to a file, which is then read."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _spool(spark: SparkSession, pieces: Iterable[str], folder: str | None) -> str:
    """Writes the pieces to a new file below ``folder``, which all executors must share, and
    renames it when it is whole. Default: the shared checkpoint folder, else (on one machine) a
    temporary one. Remote folders are written by Hadoop's file systems."""
    folder = folder or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("on a cluster, give a folder that all executors share, or set spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="quern-stream-")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder, f"stream-{os.urandom(8).hex()}")
    part = target.suffix(".part")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(part)
    try:
        held: list[str] = []
        size = 0
        for piece in pieces:
            held.append(piece)
            size += len(piece)
            if size > 1 << 20:
                out.write(bytearray("".join(held).encode()))
                held, size = [], 0
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()
    system.rename(part, target)
    return target.toString()


def line_stream(spark: SparkSession, stream: Iterable[str], folder: str | None = None) -> DataFrame:
    """The lines of an iterable of text pieces (an open file, say) as ``value``."""
    return spark.read.text(_spool(spark, stream, folder))


def object_stream(spark: SparkSession, objects: Iterable[dict], schema: str | T.StructType, folder: str | None = None) -> DataFrame:
    """Objects of an iterable (a database cursor, say) as typed rows."""
    lines = (json.dumps(o, ensure_ascii=False) + "\n" for o in objects)
    return spark.read.schema(schema).json(_spool(spark, lines, folder))
