"""Forests against exhaustive search, and the parts of trees against whole trees."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import forest


def _plan(classes, dim, features=None, depth=20, trees=1):
    return forest.Plan([np.arange(31)] * dim, classes, trees, depth, 42, features or dim, 0.0, 1.0)


def _exhaustive(classes, codes, y, w, depth):
    """What a tree says of each row: every split of every node tried, leaves of one class joined."""
    def impurity(at):
        n = w[at].sum()
        if classes:
            share = np.bincount(y[at].astype(int), w[at], classes) / n
            return 1 - (share**2).sum()
        mean = (w[at] * y[at]).sum() / n
        return (w[at] * (y[at] - mean) ** 2).sum() / n

    def node(at, level):
        train = at[w[at] > 0]
        counts = np.bincount(y[train].astype(int), w[train], classes) if classes else None
        says = counts / counts.sum() if classes else np.array([(w[train] * y[train]).sum() / w[train].sum(), 1.0])
        best = None
        for f in range(codes.shape[1]) if level < depth else ():
            for cut in range(31):
                a, b = train[codes[train, f] <= cut], train[codes[train, f] > cut]
                if len(a) and len(b):
                    gain = impurity(train) - (w[a].sum() * impurity(a) + w[b].sum() * impurity(b)) / w[train].sum()
                    if gain > 1e-10 and (best is None or gain > best[0] + 1e-10):
                        best = gain, f, cut
        if not best:
            return {i: says for i in at}, True, says
        _, f, cut = best
        sides = [node(at[codes[at, f] <= cut], level + 1), node(at[codes[at, f] > cut], level + 1)]
        if classes and all(s[1] for s in sides) and sides[0][2].argmax() == sides[1][2].argmax():
            return {i: says for i in at}, True, says
        return sides[0][0] | sides[1][0], False, says

    found = node(np.arange(len(y)), 0)[0]
    return np.array([found[i] for i in range(len(y))])


@pytest.mark.parametrize("classes", [3, None])
@pytest.mark.parametrize("depth", [0, 2, 20])
def test_a_tree_equals_exhaustive_search(monkeypatch, classes, depth):
    monkeypatch.setattr(forest, "HELD", 500)  # a few nodes at a time
    rng = np.random.default_rng(7)
    for _ in range(6):
        codes = rng.integers(0, 6, (70, 3)).astype(np.uint8)
        y, w = rng.integers(0, 3, 70).astype(float), rng.poisson(1, 70).astype(float)
        plan = _plan(classes, 3)
        leaf, sums = forest.grow(plan, codes, y, w, depth, rng)
        assert np.allclose(forest.said(plan, sums)[leaf], _exhaustive(classes, codes, y, w, depth))


def test_draws_are_poisson_with_mean_one():
    found = np.concatenate([forest.draws(np.arange(20_000), t, 42) for t in range(5)])
    assert np.allclose(np.bincount(found, minlength=4)[:4] / len(found), np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.005)
    assert not np.array_equal(found[:20_000], found[20_000:40_000])


def _rows(spark, n=400):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, 4)), 3)
    rows = [(None if i % 50 == 0 else i // 2, v.tolist(), int((v[0] > 0) + 2 * (v[1] > 0.3)), i % 4 != 0) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *rows[:9]], "id long, vec array<double>, label int, trains boolean")


@pytest.mark.parametrize("part_rows", [30, 1 << 17])
def test_classes_of_all_rows_with_trees_in_parts(spark, part_rows):
    rows = _rows(spark)
    found = forest.predictions(rows, F.col("trains"), "vec", "label", 4, trees=15, part_rows=part_rows)
    assert found.columns == ["id", "vec", "label", "trains", "prediction"]
    got = found.collect()
    assert sorted((str(r["id"]), r["vec"]) for r in got) == sorted((str(r["id"]), r["vec"]) for r in rows.collect())
    held = [r["prediction"] == r["label"] for r in got if not r["trains"]]
    assert sum(held) >= 0.85 * len(held)


def test_upper_nodes_split_as_whole_trees_do(spark):
    """With all features to choose from, a tree is the same whether it is grown whole or in parts."""
    rows = _rows(spark).withColumn("one", F.slice("vec", 1, 1))
    for target, classes in (("label", 4), ("label", None)):
        whole, parts = ({(str(r["id"]), tuple(r["vec"])): r["prediction"] for r in forest.predictions(
            rows, F.col("trains"), "one", target, classes, trees=3, depth=3, part_rows=p).collect()} for p in (1 << 17, 20))
        assert whole.keys() == parts.keys()
        assert sum(abs(whole[k] - parts[k]) < 1e-9 for k in whole) >= (0.97 if classes else 1) * len(whole)  # leaves are joined inside a part only


def test_parts_hold_no_more_rows_than_asked(spark):
    plan = _plan(2, 2, trees=4)
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 32, (500, 2)).astype(np.uint8)
    codes[:200] = 3  # copies, which nothing can split
    coded = spark.createDataFrame([(i, bytearray(c.tobytes()), float(c[0] > 9) if i % 5 else float("nan")) for i, c in enumerate(codes)], "_row long, codes binary, y double")
    for top in forest._tops(plan, coded, 500, 50):
        place = top.place(codes)
        for n in set(place.tolist()):
            assert top.left[n] < 0 and (top.closed[n] or (place == n).sum() <= 50)
        assert top.closed[place[0]] and (place == place[0]).sum() >= 200


def test_gaps_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0], 0), (2, None, 1), (3, [2.0], None)], "id long, vec array<double>, label int")
    for train in ("id <= 2", "id <> 2", "id = 1", "id > 3"):
        with pytest.raises(ValueError):
            forest.predictions(rows, F.expr(train), "vec", "label", 2, trees=2)
