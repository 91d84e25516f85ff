"""Linear models by full-batch gradient descent.

The input is cached in partitions for all cores. By default (``engine="blocks"``) each partition
holds it as matrices, and an iteration is one pass of matrix-vector products: every task returns one
row, its part of the gradient and its count. With ``engine="columns"`` the cached input has one
column a feature and an iteration is one aggregation in generated code; the weights come in as a
broadcast row (of a fixed, small size), so that this code is compiled once. Both give the same model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.ml.scaler import dimensions

LOSSES = ("hinge", "log", "square")
PENALTIES = ("l2", "l1", "none")
ENGINES = ("blocks", "columns")
#: Numbers of a block at most.
BLOCK_NUMBERS = 1 << 20


def _pulls(loss: str, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    if loss == "hinge":
        return np.where(y * margin < 1, -y, 0.0)
    if loss == "log":
        return 1 / (1 + np.exp(-margin)) - y
    return margin - y


@dataclass
class SGDLinearModel:
    """``loss`` hinge (labels -1, 1), log (labels 0, 1) or square; ``penalty`` l2, l1 or none."""

    loss: str = "hinge"
    penalty: str = "l2"
    step_size: float = 1.0
    reg_param: float = 0.001
    fit_intercept: bool = True
    proba: bool = False
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def __post_init__(self) -> None:
        if self.loss not in LOSSES or self.penalty not in PENALTIES:
            raise ValueError(f"loss must be of {LOSSES} and penalty of {PENALTIES}")

    def _pull(self, label: Column, margin: Column) -> Column:
        """The factor of the features in a row's gradient."""
        if self.loss == "hinge":
            return F.when(label * margin < 1, -label).otherwise(F.lit(0.0))
        if self.loss == "log":
            return 1 / (1 + F.exp(-margin)) - label
        return margin - label

    def _step(self, w: float, gradient: float, step: float) -> float:
        if self.penalty == "l2":
            return w - step * (gradient + self.reg_param * w)
        if self.penalty == "l1":
            return w - step * (gradient + self.reg_param * ((w > 0) - (w < 0)))
        return w - step * gradient

    def fit(self, df: DataFrame, iterations: int, label: str = "label", features: str = "features", engine: str = "blocks") -> SGDLinearModel:
        """Continues from the weights at hand. Null features count as zero, null labels are left out
        of the gradient but not of the count."""
        if engine not in ENGINES:
            raise ValueError(f"engine must be of {ENGINES}")
        spark = df.sparkSession
        rows = df.select(F.col(label).cast("double").alias("y"), F.col(features).alias("x"))
        n = dimensions(df, features)
        w = ([self.intercept] if self.fit_intercept else []) + [*self.weights, *[0.0] * (n - len(self.weights))][:n]
        rows, gradient = (self._blocks if engine == "blocks" else self._columns)(rows, n)
        cores = spark.sparkContext.defaultParallelism
        rows = (rows.repartition(cores) if engine == "columns" and rows.rdd.getNumPartitions() < cores else rows).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for t in range(iterations if w else 0):
                *total, count = gradient(rows, w)
                if not count:
                    break
                step = self.step_size / math.sqrt(t + 1)
                w = [self._step(a, (g or 0.0) / count, step) for a, g in zip(w, total, strict=True)]
        finally:
            rows.unpersist()
        self.intercept, self.weights = (w[0], w[1:]) if self.fit_intercept else (0.0, w)
        return self

    def _blocks(self, rows: DataFrame, n: int) -> tuple[DataFrame, Callable]:
        """Rows packed into matrices, dealt to all cores, and the gradient over them."""
        loss, intercept = self.loss, self.fit_intercept
        width = n + 1
        filled = F.array(*[F.coalesce(F.get("x", F.lit(i)).cast("double"), F.lit(0.0)) for i in range(max(n, 1))])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)[:, :n]
                whole = np.column_stack([y, x])
                for at in range(0, len(y), max(1, BLOCK_NUMBERS // width)):
                    yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(whole[at : at + max(1, BLOCK_NUMBERS // width)]).tobytes()], pa.binary())], names=["block"])

        packed = rows.select("y", filled.alias("x")).mapInArrow(pack, "block binary")
        packed = packed.repartition(rows.sparkSession.sparkContext.defaultParallelism) if rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism else packed

        def gradient(blocks: DataFrame, w: list[float]) -> list[float]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                weights, total, count = np.array(w), np.zeros(len(w)), 0
                for batch in batches:
                    for raw in batch.column(0):
                        block = np.frombuffer(raw.as_buffer(), dtype=np.float64).reshape(-1, width)
                        y, x = block[:, 0], block[:, 1:]
                        margin = x @ weights[1:] + weights[0] if intercept else x @ weights
                        pull = np.where(np.isnan(y), 0.0, _pulls(loss, y, margin))
                        total += np.r_[pull.sum(), pull @ x] if intercept else pull @ x
                        count += len(y)
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([count], pa.int64())], names=["g", "n"])

            parts = blocks.mapInArrow(run, "g array<double>, n long").collect()  # a row a partition
            return [*np.sum([r["g"] for r in parts], axis=0).tolist(), sum(r["n"] for r in parts)] if parts else [*[0.0] * len(w), 0]

        return packed, gradient

    def _columns(self, rows: DataFrame, n: int) -> tuple[DataFrame, Callable]:
        """One column a feature, and the gradient as one aggregation."""
        names = [f"x{i}" for i in range(n)]
        wide = rows.select("y", *[F.coalesce(F.get("x", F.lit(i)).cast("double"), F.lit(0.0)).alias(x) for i, x in enumerate(names)])
        columns = ([F.lit(1.0)] if self.fit_intercept else []) + [F.col(x) for x in names]
        margin = F.lit(0.0)
        for i, x in enumerate(columns):
            margin = margin + x * F.col(f"w{i}")
        pull = self._pull(F.col("y"), margin).alias("g")
        sums = [*[F.sum(x * F.col("g")) for x in columns], F.count(F.lit(1))]

        def gradient(rows: DataFrame, w: list[float]) -> list[float]:
            values = ", ".join(f"double('{weight!r}')" for weight in w)
            weights = rows.sparkSession.sql(f"SELECT * FROM VALUES ({values}) AS w({', '.join(f'w{i}' for i in range(len(w)))})")
            return list(rows.crossJoin(F.broadcast(weights)).select(*names, pull).agg(*sums).first())

        return wide, gradient

    def predict(self, features: Column | str = "features") -> Column:
        """The margin, or with ``proba`` its sigmoid, as a column expression."""
        c = F.col(features) if isinstance(features, str) else features
        margin = F.lit(float(self.intercept))
        for i, weight in enumerate(self.weights):
            margin = margin + F.coalesce(F.get(c, F.lit(i)).cast("double"), F.lit(0.0)) * F.lit(float(weight))
        return 1 / (1 + F.exp(-margin)) if self.proba else margin
