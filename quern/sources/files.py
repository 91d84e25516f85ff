"""Datasets from files: text (plain or gzip), Parquet, JSON lines, CSV; local, HDFS or cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, folder or glob names, in name order, by Hadoop's file systems."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(pattern) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath().toString() for s in inner if s.isFile() and s.getPath().getName()[0] not in "_."]
    return sorted(found)


def text_file(spark: SparkSession, path: str, max_files: int | None = None, parquet: bool = False, positions: bool = False) -> DataFrame:
    """Lines as ``value`` (blank ones kept, CR, LF or CRLF end them); gzip by suffix; globs and
    folders; ``s3a://``, ``abfss://``, ``hdfs://`` by Hadoop's connectors. ``max_files`` takes
    the first by name. Paths that end in ``.parquet`` are read as Parquet. ``positions`` adds
    ``_file`` and ``_pos`` (where the file's split starts, and the line's place within it), which
    order lines by file name and then as they stand, however splits are packed into partitions.
    """
    paths = [path.rstrip("/") or "/"] if max_files is None else list_files(spark, path)[:max_files]
    if parquet or path.endswith(".parquet"):
        return spark.read.parquet(*paths)
    if not paths:
        return spark.createDataFrame([], "value string, _file string, _pos array<long>" if positions else "value string")
    lines = spark.read.text(paths)
    place = F.array(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), place.alias("_pos")) if positions else lines


def json_file(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_file(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
