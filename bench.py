"""Times the headline queries; prints one JSON line.

``$BENCH_SF_DIR`` names the tables, ``$BENCH_CPUS`` the threads. Each query runs once to warm up
and then ``REPEATS`` times, the least counts; its result is counted in whole (Spark's noop sink).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.ml.sgd import SGDLinearModel
from quern.plans import catalog

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 2
QUERIES = ["q_pipeline_slice", "q_flat_map_wordcount", "q_aggregate_by_key", "q_group_by_key", "q_cogroup", "q_left_outer", "q_intersection", "q_subtract", "q_distinct", "q_sort_by", "q_take", "q_kmeans_step", "q_metrics", "q_session_window"]


def regression(spark: SparkSession, iterations: int) -> None:
    """Logistic regression with 16 features by full-batch gradient descent."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    parts = [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_linenumber") / 7]
    features = F.array(*[p * F.lit(1.0 + i / 4) for i in range(4) for p in parts])
    rows = items.select((F.col("l_returnflag") == "R").cast("double").alias("label"), features.alias("features"))
    SGDLinearModel(loss="log", reg_param=1.0).fit(rows, iterations)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f) -> float:
    f()
    best = float("inf")
    for _ in range(REPEATS):
        began = time.perf_counter()
        f()
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: timed(lambda f=catalog.QUERIES[name]: run(f(spark, SF))) for name in QUERIES}
    seconds["lr_10_iterations"] = timed(lambda: regression(spark, 10))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
