"""Nested search on Gram matrices against explicit fits of every training set."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import gram


def data(n=240, dim=7, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + rng.normal(size=dim) * 1e5  # far from zero against the spread
    y = np.clip(2.5 + x[:, 0] - x[:, 0].mean() - 0.5 * (x[:, 2] - x[:, 2].mean()) + rng.normal(size=n) * 0.3, 0.5, 4.5)
    x[:, 5] = 3.25
    gaps = rng.random((n, dim)) < 0.15
    gaps[:, [0, 3, 5]] = False
    x[gaps] = np.nan
    x[:, 6] = np.nan
    subject = rng.integers(0, 24, n)
    return x, y, subject, subject % 4 + 1


def frame(spark, x, y, subject, fold):
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], float(t), int(s), int(f), "own") for i, (r, t, s, f) in enumerate(zip(x, y, subject, fold))]
    return spark.createDataFrame(rows, "id int, vec array<double>, y double, subject int, fold int, inner string")


def explicit(train_x, train_y, test_x):
    """Imputed, indicated, filtered, standardised and ranked training and test columns."""
    out = []
    for x in (train_x, test_x):
        med = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in train_x.T])
        gaps = np.isnan(train_x).any(axis=0)
        out.append(np.hstack([np.where(np.isnan(x), med, x), np.isnan(x)[:, gaps]]))
    train, test = out
    alive = [j for j in range(train.shape[1]) if np.ptp(train[:, j]) > 0]
    mean, sd = train.mean(axis=0), train.std(axis=0)
    r2 = {j: np.corrcoef(train[:, j], train_y)[0, 1] ** 2 for j in alive}
    order = sorted(alive, key=lambda j: (-r2[j], -j))
    return [(z[:, order] - mean[order]) / sd[order] for z in (train, test)]


def inner_folds(subject, fold):
    return [(int(s), o, int(s) // 4 % 3 + 1) for s in sorted(set(subject)) for o in range(1, 5) if s % 4 + 1 != o]


@pytest.mark.parametrize("ratios", [None, (0.2, 0.9)])
def test_nested_search_equals_explicit_fits(spark, ratios):
    x, y, subject, fold = data()
    rows = frame(spark, x, y, subject, fold)
    inner = spark.createDataFrame(inner_folds(subject, fold), "subject int, outer_fold int, inner_fold int")
    alphas = (0.1, 10.0) if ratios is None else (0.05, 0.5)
    search = gram.nested_search(rows, "vec", "y", "subject", "fold", 4, 3, alphas, (2, "all"), ratios, inner)
    got = {(r.outer_fold, r.alpha, r.l1_ratio, r.k): r for r in search.table.collect()}
    own = subject // 4 % 3 + 1
    for o in range(1, 5):
        scores = {}
        for alpha in alphas:
            for ratio in ratios or [None]:
                for k in (2, "all"):
                    errors = []
                    for i in (1, 2, 3):
                        tr, te = (fold != o) & (own != i), (fold != o) & (own == i)
                        a, b = explicit(x[tr], y[tr], x[te])
                        p = predicted(a, b, y[tr], alpha, ratio, k)
                        errors.append(np.abs(np.clip(p, 1, 4) - y[te]).mean())
                    r = got[o, alpha, ratio, str(k)]
                    assert r.mean_error == pytest.approx(np.mean(errors), abs=1e-7)
                    assert r.sd_error == pytest.approx(np.std(errors), abs=1e-7) and r.violation < 1e-8
                    scores[alpha, ratio, k] = np.mean(errors)
        best = min(scores, key=lambda c: (round(scores[c], 12), -c[0], -(c[1] or 0)))
        assert [c for c, r in got.items() if c[0] == o and r.selected] == [(o, best[0], best[1], str(best[2]))]
        a, b = explicit(x[fold != o], y[fold != o], x[fold == o])
        want = predicted(a, b, y[fold != o], *best)
        mine = np.array([r.prediction_raw for r in search.predict(rows, "fold").where(F.col("fold") == o).orderBy("id").collect()])
        assert np.allclose(mine, want, atol=1e-6)


def predicted(a, b, y, alpha, ratio, k):
    size = a.shape[1] if k == "all" else min(k, a.shape[1])
    a, b, z = a[:, :size], b[:, :size], y - y.mean()
    if ratio is None:
        w = np.linalg.solve(a.T @ a + alpha * np.eye(size), a.T @ z)
    else:  # plain coordinate descent on the rows
        w, n = np.zeros(size), len(a)
        for _ in range(4000):
            for j in range(size):
                pull = a[:, j] @ (z - a @ w + a[:, j] * w[j]) / n
                w[j] = np.sign(pull) * max(abs(pull) - alpha * ratio, 0) / (a[:, j] @ a[:, j] / n + alpha * (1 - ratio))
    return y.mean() + b @ w


def test_ties_take_the_larger_penalty(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0], 2.0, i % 10, i % 10 % 5 + 1) for i in range(60)], "id int, vec array<double>, y double, subject int, fold int")
    search = gram.nested_search(rows, "vec", "y", "subject", "fold", tops=(1, "all"))
    chosen = search.table.where("selected").collect()
    assert len(chosen) == 5 and all(r.alpha == 100.0 and r.mean_error == 0.0 for r in chosen)


def test_one_factor_serves_all_prefixes():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 12))
    system = gram.System(50, a.T @ a / 50, rng.normal(size=12), np.eye(12), np.zeros(12), np.ones(12), 0.0)
    for (alpha, k), w in gram.ridge_path(system, (0.1, 5.0), (1, 4, 12)).items():
        assert np.allclose(w, np.linalg.solve(system.correlation[:k, :k] + alpha / 50 * np.eye(k), system.target[:k]))


def test_net_path_is_optimal_where_the_strong_rule_fails():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a = rng.normal(size=(40, 25)) @ rng.normal(size=(25, 25))
        a = (a - a.mean(axis=0)) / a.std(axis=0)
        c, b = a.T @ a / 40, a.T @ rng.normal(size=40) / 40
        for ratio in (0.05, 0.5, 1.0):
            for alpha, w in gram.net_path(c, b, (1.0, 0.3, 0.1, 0.01), ratio).items():
                assert gram.net_violation(c, b, w, alpha * ratio, alpha * (1 - ratio)).max() < 1e-8


def test_a_group_that_trains_its_own_fold_is_refused(spark):
    x, y, subject, fold = data(40)
    wrong = spark.createDataFrame([(int(s), o, 1) for s in set(subject) for o in range(1, 5)], "subject int, outer_fold int, inner_fold int")
    with pytest.raises(Exception, match="trains its own"):
        gram.nested_search(frame(spark, x, y, subject, fold), "vec", "y", "subject", "fold", 4, 3, inner=wrong)


def test_single_fit_refuses_gaps_and_gives_plain_weights(spark):
    x, y, subject, fold = data()
    with pytest.raises(ValueError):
        gram.fit(frame(spark, x, y, subject, fold), "vec", "y", [1.0])
    full = x[:, [0, 3]]
    r = gram.fit(frame(spark, full, y, subject, fold), "vec", "y", [1e-9], standardize=False).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(len(y)), full - full.mean(axis=0)]), y, rcond=None)[0]
    assert np.allclose(r.weights, want[1:], atol=1e-6)
    assert np.allclose(r.intercept + full @ np.array(r.weights), want[0] + (full - full.mean(axis=0)) @ want[1:], atol=1e-5)
