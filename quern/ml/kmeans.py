"""Lloyd's k-means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.ml.scaler import dimensions


@dataclass
class KMeans:
    """Stops when the means move by less than ``max_mse`` (squared, summed) or after
    ``max_iterations``. Without given ``means`` a sample of the rows is taken."""

    n_clusters: int
    means: list[list[float]] | None = None
    max_mse: float = 1e-7
    max_iterations: int = 100
    seed: int = 0

    def distances(self, features: Column | str) -> list[Column]:
        c = F.col(features) if isinstance(features, str) else features
        out = []
        for mean in self.means or []:
            total = F.lit(0.0)
            for i, m in enumerate(mean):
                delta = F.get(c, F.lit(i)).cast("double") - F.lit(float(m))
                total = total + delta * delta
            out.append(total)
        return out

    def predict(self, features: Column | str = "features") -> Column:
        """The number of the nearest mean; of equal ones the first."""
        d = F.array(*self.distances(features))
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    def step(self, df: DataFrame, features: str = "features") -> DataFrame:
        """cluster, n and the new mean's components m0, m1, ... in one aggregation."""
        n = len(self.means[0])
        rows = df.select(self.predict(features).alias("cluster"), features)
        return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.get(features, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(n)])

    def fit(self, df: DataFrame, features: str = "features") -> KMeans:
        """A cluster that loses all its rows keeps its mean."""
        rows = df.select(features).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if self.means is None:
                sample = rows.orderBy(F.rand(self.seed)).limit(self.n_clusters).collect()
                self.means = [[float(x) for x in r[0]] for r in sample]
            if not self.means or not dimensions(rows, features):
                return self
            for _ in range(self.max_iterations):
                new = [list(m) for m in self.means]
                for r in self.step(rows, features).collect():  # one row a cluster
                    new[r["cluster"]] = list(r[2:])
                moved = sum((a - b) ** 2 for x, y in zip(new, self.means, strict=True) for a, b in zip(x, y, strict=True))
                self.means = new
                if moved < self.max_mse:
                    break
        finally:
            rows.unpersist()
        return self
