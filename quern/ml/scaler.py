"""Standardisation by mean and population standard deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimensions(df: DataFrame, features: str) -> int:
    return df.agg(F.max(F.size(features))).first()[0] or 0


@dataclass
class StandardScaler:
    mean: list[float]
    std: list[float]

    @classmethod
    def fit(cls, df: DataFrame, features: str = "features") -> StandardScaler:
        """One pass for all features."""
        n = dimensions(df, features)
        if not n:
            return cls([], [])
        each = [F.get(features, F.lit(i)) for i in range(n)]
        row = df.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
        return cls(list(row[:n]), list(row[n:]))

    def transform(self, features: Column | str = "features") -> Column:
        """(x - mean) / std of each feature; null where the deviation is zero."""
        c = F.col(features) if isinstance(features, str) else features
        return F.array(*[F.try_divide(F.get(c, F.lit(i)) - F.lit(m), F.lit(s)) for i, (m, s) in enumerate(zip(self.mean, self.std, strict=True))])
