"""Metrics of a binary classifier over thresholds, from one pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Metrics:
    rates: list[dict[str, float | int | None]]
    au_roc: float
    au_pr: float
    threshold: float  # of the best F1


def confusion(df: DataFrame, steps: int = 10, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """threshold, tp, fp, fn, tn: a prediction beyond i / steps is positive, a label over 0 true.

    All thresholds are sums of one aggregation, unpivoted from its single row.
    """
    p, y = F.col(prediction), F.col(label) > 0
    sums = []
    for i in range(steps):
        above = F.coalesce(p > F.lit(i / steps), F.lit(False))
        for name, hit in (("tp", above & y), ("fp", above & ~y), ("fn", ~above & y), ("tn", ~above & ~y)):
            sums.append(F.count_if(hit).alias(f"{name}{i}"))
    row = F.array(*[F.struct(F.lit(i / steps).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i in range(steps)])
    return df.agg(*sums).select(F.explode(row).alias("r")).select("r.*")


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds the rates; null where one is 0 / 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(fp, fp + tn).alias("fpr"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp) - 1).alias("j"),
    )


def area_under(points: list[tuple[float | None, float | None]]) -> float:
    """Trapezoids under the points in order of x; points with an undefined part are left out."""
    known = sorted((p for p in points if None not in p), key=lambda p: p[0])
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(known, known[1:], strict=False))


def classification_metrics(df: DataFrame, steps: int = 10, prediction: str = "prediction", label: str = "label") -> Metrics:
    rates = [r.asDict() for r in with_rates(confusion(df, steps, prediction, label)).orderBy("threshold").collect()]  # ``steps`` rows
    best = max(rates, key=lambda r: (r["f1"] or 0.0, -r["threshold"]))
    return Metrics(rates, area_under([(r["fpr"], r["recall"]) for r in rates]), area_under([(r["recall"], r["precision"]) for r in rates]), best["threshold"])
