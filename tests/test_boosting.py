"""Histogram boosting against trees grown by exhaustive search in plain numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import boosting


def data(n=150, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)  # many equal values
    x[:, 3] = 2.0
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] + 0.3 * rng.normal(size=n) > 0.4)
    return x, y


def frame(spark, x, y, kind="int"):
    rows = [(i, [float(v) for v in r], None if t is None else t.item(), "own") for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"id int, v array<double>, label {kind}, y string")


def split(x, r, cuts):
    best = (0.0, None, None)
    for f, cut in enumerate(cuts):
        for c in cut:
            left = x[:, f] <= c
            if left.any() and not left.all():
                a, b = r[left], r[~left]
                gain = len(a) * len(b) / len(r) * (a.mean() - b.mean()) ** 2
                if gain > best[0] + 1e-12:
                    best = (gain, f, c)
    return best


def plain(x, y, classes, rounds, rate, cuts):
    """Margins after each round."""
    if classes:
        start = np.log(np.bincount(y, minlength=classes) / len(y))
    else:
        start, classes = np.array([y.mean()]), 1
    margins = np.tile(start, (len(y), 1)).astype(float)
    for _ in range(rounds):
        p = boosting.shares(margins)
        step = np.zeros_like(margins)
        for c in range(len(start)):
            r = y - margins[:, 0] if len(start) == 1 else (y == c) - p[:, c]
            leaves = [np.ones(len(y), bool)]
            for _ in range(2):
                grown = []
                for leaf in leaves:
                    _, f, cut = split(x[leaf], r[leaf], cuts) if leaf.any() else (0, None, None)
                    grown += [leaf] if f is None else [leaf & (x[:, f] <= cut), leaf & (x[:, f] > cut)]
                leaves = grown
            for leaf in leaves:
                if len(start) == 1:
                    step[leaf, 0] = r[leaf].mean()
                else:
                    step[leaf, c] = (len(start) - 1) / len(start) * r[leaf].sum() / (np.abs(r[leaf]) * (1 - np.abs(r[leaf]))).sum()
        margins = margins + rate * step
    return margins


def test_classes_equal_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    x, y = data()
    rows = frame(spark, x, y).repartition(3)
    booster = boosting.boost(rows, "v", "label", 3, rounds=5, rate=0.3)
    got = np.array([r.p for r in frame(spark, x, y).withColumn("p", booster.predict(rows, "v")).orderBy("id").collect()])
    assert np.allclose(got, boosting.shares(plain(x, y, 3, 5, 0.3, booster.cuts)), atol=1e-9)
    earlier = np.array([r.p for r in frame(spark, x, y).withColumn("p", booster.predict(rows, "v", rounds=2)).orderBy("id").collect()])
    assert np.allclose(earlier, boosting.shares(plain(x, y, 3, 2, 0.3, booster.cuts)), atol=1e-9)
    assert all(b <= a for a, b in zip(booster.losses, booster.losses[1:])) and len(booster.losses) == 6


def test_regression_equals_plain_trees(spark):
    x, y = data()
    target = x[:, 0] * 2 - x[:, 1] + y
    booster = boosting.boost(frame(spark, x, target, "double"), "v", "label", None, rounds=4, rate=0.5)
    got = np.array([r.p for r in frame(spark, x, y).withColumn("p", booster.predict(frame(spark, x, y), "v")).orderBy("id").collect()])
    assert np.allclose(got, plain(x, target, None, 4, 0.5, booster.cuts)[:, 0], atol=1e-9)
    assert booster.losses[-1] < booster.losses[0]


def test_odd_tables(spark):
    x, y = data(20)
    same = boosting.boost(frame(spark, np.ones((20, 2)), y), "v", "label", 3, rounds=2)
    assert same.losses == pytest.approx([same.losses[0]] * 3)  # nothing to split on
    one = frame(spark, x, np.zeros(20, int))
    booster = boosting.boost(one, "v", "label", 3, rounds=2)
    assert one.select(F.min(F.get(booster.predict(one, "v"), F.lit(0)))).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        boosting.boost(frame(spark, x, y + 5), "v", "label", 3, rounds=1)
    unlabelled = frame(spark, x, [None, *y[1:]])
    assert boosting.boost(unlabelled, "v", "label", 3, rounds=1).losses[0] == pytest.approx(boosting.boost(frame(spark, x[1:], y[1:]), "v", "label", 3, rounds=1).losses[0])
