"""Linear machines: certificates against plain optimisation, and rows that are refused."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import linear


def frame(spark, x, y):
    return spark.createDataFrame([([float(v) for v in r], None if t is None else float(t), "own") for r, t in zip(x, y)], "v array<double>, t double, x string").repartition(3)


def data(n=120, dim=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    return x, x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) * 0.4


def hinge(x, y, c, w):
    z = np.hstack([x, np.ones((len(x), 1))])
    return w @ w / 2 + c * (np.maximum(1 - y * (z @ w), 0) ** 2).sum()


def test_squared_hinge_is_optimal(spark):
    x, t = data()
    label = (t > 0).astype(int) + (t > 1)
    for c in (0.1, 10.0):
        for m in linear.squared_hinge(frame(spark, x, label), "v", "t", 3, c, tolerance=1e-9):
            assert -1e-9 <= m.gap <= 1e-9
            y = np.where(label == m.positive, 1.0, -1.0)
            assert m.objective == pytest.approx(hinge(x, y, c, m.w))
            rng = np.random.default_rng(2)
            assert all(hinge(x, y, c, m.w + rng.normal(size=6) * 10.0**-k) > m.objective - 1e-8 for k in range(1, 5) for _ in range(20))


@pytest.mark.parametrize("c,epsilon", [(0.01, 0.0), (1.0, 0.1), (10.0, 0.0), (10.0, 0.2)])
def test_insensitive_is_within_its_gap(spark, c, epsilon):
    x, t = data()
    m = linear.insensitive(frame(spark, x, t), "v", "t", c, epsilon)
    assert 0 <= m.gap <= 1e-4
    z = np.hstack([x, np.ones((len(x), 1))])
    objective = lambda w: w @ w / 2 + c * np.maximum(np.abs(t - z @ w) - epsilon, 0).sum()
    assert m.objective == pytest.approx(objective(m.w))
    # plain sub-gradient descent can't get below what the gap allows
    w, best = m.w.copy(), m.objective
    for i in range(1, 3000):
        r = t - z @ w
        w = w - (w - c * (np.sign(r) * (np.abs(r) > epsilon)) @ z) / (i + 50)
        best = min(best, objective(w))
    assert best >= m.objective - m.gap * max(1.0, m.objective) - 1e-12


def test_many_machines_share_passes_and_values_are_theirs(spark):
    x, t = data()
    rows = frame(spark, x, [None, *t[1:]])
    machines = [linear.Machine(c, epsilon=e) for c in (0.1, 1.0) for e in (0.0, 0.3)]
    linear.fit(rows, "v", "t", machines)
    alone = linear.insensitive(rows, "v", "t", 1.0, 0.3)
    assert np.allclose(alone.w, machines[3].w, atol=1e-8) and alone.passes == machines[3].passes
    got = rows.select("v", linear.values("v", machines).alias("d")).collect()
    assert np.allclose([r.d for r in got], [[np.append(r.v, 1.0) @ m.w for m in machines] for r in got])


def test_nothing_to_learn_from(spark, monkeypatch):
    monkeypatch.setattr(linear, "GIVE_UP", 4)
    with pytest.raises(ValueError):
        linear.insensitive(frame(spark, *data(3)).where(F.lit(False)), "v", "t")
    with pytest.raises(ArithmeticError):
        x, t = data()
        linear.fit(frame(spark, x, t), "v", "t", [linear.Machine(10.0)], tolerance=-1.0)
