"""Session helpers: configuration, worker environment, shipped modules."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "quern", master: str | None = None, env: dict[str, str] | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``env`` is set on the workers, ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {f"spark.executorEnv.{k}": v for k, v in (env or {}).items()} | conf).items():
        builder = builder.config(key, value)
    os.environ.update(env or {})
    return builder.getOrCreate()


def require(spark: SparkSession, *paths: str) -> None:
    """Ships Python modules (files, packages as zip) to the workers."""
    for path in paths:
        spark.sparkContext.addPyFile(path)
