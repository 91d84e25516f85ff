import math

import pytest
from pyspark.sql import functions as F

from quern.ml.kmeans import KMeans
from quern.ml.metrics import area_under, classification_metrics
from quern.ml.scaler import StandardScaler
from quern.ml.sgd import SGDLinearModel


def points(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "features array<double>")


def test_scaler(spark):
    df = points(spark, [[0.0, 0.0], [0.0, 0.0], [1.0, 1.0], [1.0, 1.0]])
    s = StandardScaler.fit(df)
    assert s.mean == [0.5, 0.5] and s.std == [0.5, 0.5]
    assert sorted(r[0] for r in df.select(s.transform()).collect()) == [[-1, -1], [-1, -1], [1, 1], [1, 1]]
    flat = points(spark, [[3.0], [3.0]])
    assert flat.select(StandardScaler.fit(flat).transform()).first()[0] == [None]


def test_sgd_golden(spark):
    df = spark.createDataFrame([(1.0, [0.5, -0.7]), (-1.0, [-0.5, 0.7])], "label double, features array<double>")
    model = SGDLinearModel().fit(df, 2)
    assert model.weights == pytest.approx([0.8531998372026804, -1.1944797720837526], rel=1e-15)
    two = points(spark, [[2.0, -2.0]])
    assert two.select(model.predict()).first()[0] > 0
    model.proba = True
    assert 0.5 < two.select(model.predict()).first()[0] < 1


@pytest.mark.parametrize("loss, label", [("hinge", -1.0), ("log", 0.0), ("square", -1.0)])
@pytest.mark.parametrize("penalty", ["l2", "l1", "none"])
def test_sgd_separates(spark, loss, label, penalty):
    df = spark.createDataFrame([(1.0, [1.0, 0.2]), (1.0, [0.8, None]), (label, [-1.0, 0.1]), (label, [-0.7, 0.0])], "label double, features array<double>")
    model = SGDLinearModel(loss=loss, penalty=penalty).fit(df, 5)
    assert [r[0] > 0 for r in df.select(model.predict()).collect()] == [True, True, False, False]


@pytest.mark.parametrize("loss", ["hinge", "log", "square"])
@pytest.mark.parametrize("intercept", [True, False])
def test_engines_agree(spark, loss, intercept):
    rows = [(float(i % 2) if i % 11 else None, [i / 50, None if i % 5 == 0 else (i % 7) / 7, 1.0 - i / 90]) for i in range(100)]
    df = spark.createDataFrame(rows, "label double, features array<double>")
    a, b = (SGDLinearModel(loss=loss, fit_intercept=intercept).fit(df, 4, engine=e) for e in ("blocks", "columns"))
    assert [a.intercept, *a.weights] == pytest.approx([b.intercept, *b.weights], rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError):
        SGDLinearModel().fit(df, 1, engine="rows")


def test_sgd_options(spark):
    with pytest.raises(ValueError):
        SGDLinearModel(loss="none")
    empty = spark.createDataFrame([], "label double, features array<double>")
    assert SGDLinearModel().fit(empty, 3).weights == []
    df = spark.createDataFrame([(1.0, [1.0]), (1.0, [1.0])], "label double, features array<double>")
    assert SGDLinearModel(fit_intercept=False).fit(df, 1).intercept == 0


def test_kmeans(spark):
    df = points(spark, [[1.0, 2.0], [1.0, 4.0], [1.0, 0.0], [4.0, 2.0], [4.0, 4.0], [4.0, 0.0]])
    km = KMeans(2, [[0.0, 1.0], [5.0, 1.0]]).fit(df)
    assert sorted(km.means) == [[1.0, 2.0], [4.0, 2.0]]
    a, b = (points(spark, [p]).select(km.predict()).first()[0] for p in ([0.0, 0.0], [4.0, 4.0]))
    assert a != b
    assert len(KMeans(2, seed=3).fit(df).means) == 2


def test_kmeans_keeps_empty_cluster(spark):
    df = points(spark, [[0.0], [1.0]])
    assert KMeans(2, [[0.5], [100.0]]).fit(df).means == [[0.5], [100.0]]


def test_metrics(spark):
    rows = [(0.95, 1), (0.85, 1), (0.75, 0), (0.35, 1), (0.15, 0), (0.05, -1)]
    m = classification_metrics(spark.createDataFrame(rows, "prediction double, label int"))
    at = {round(r["threshold"], 1): r for r in m.rates}
    assert (at[0.5]["tp"], at[0.5]["fp"], at[0.5]["fn"], at[0.5]["tn"]) == (2, 1, 1, 2)
    assert at[0.0]["recall"] == 1 and at[0.0]["precision"] == 0.5
    assert at[0.5]["j"] == pytest.approx(1 / 3)
    assert m.threshold in (0.2, 0.3) and 0.5 < m.au_roc <= 1


def test_area_skips_undefined():
    assert area_under([(0.0, 0.0), (None, 1.0), (1.0, 1.0)]) == 0.5
    assert area_under([]) == 0 and not math.isnan(area_under([(0.5, None)]))
