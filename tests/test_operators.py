"""Operators against plain numpy/pandas computations, on ordinary and on hot-key paths."""
import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortloom.operators import audit, folds, hdc, joins, metrics, models, ordered, prep, signal, stats, tables
from cohortloom.sources import versions


def prominent(x, limit):
    """Local maxima (plateaus once) with prominence at least ``limit``."""
    n, count, i = len(x), 0, 1
    while i < n - 1:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < n and x[j + 1] < x[i]:
            a = i
            while a > 0 and x[a - 1] <= x[i]:
                a -= 1
            b = j
            while b < n - 1 and x[b + 1] <= x[i]:
                b += 1
            count += x[i] - max(x[a : i + 1].min(), x[j : b + 1].min()) >= limit
        i = j + 1
    return count


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(3)
    parts = []
    for k, n in ((0, 900), (1, 60), (2, 2), (3, 40)):
        v = np.round(np.cumsum(rng.normal(size=n)), 1) if k != 3 else np.ones(n)
        parts.append(pd.DataFrame({"k": k, "t": np.arange(n) * 0.1, "id": np.arange(n), "v": v}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("limit", [60, 100_000])
def test_peak_counts(waves, limit):
    pdf, df = waves
    got = signal.peak_counts(df, ["k"], ["t", "id"], "v", rows_per_chunk=limit).toPandas().set_index("k").peak_count
    for k in (0, 1):
        x = pdf[pdf.k == k].v.to_numpy()
        assert got[k] == prominent(x, max(0.25 * x.std(), 1e-12))
    assert np.isnan(got[2]) and got[3] == 0


@pytest.mark.parametrize("limit", [60, 100_000])
def test_summary_with_gaps(waves, limit):
    pdf, df = waves
    gappy = df.withColumn("v", F.when(F.col("id") % 5 != 0, F.col("v")).otherwise(float("nan")))
    got = signal.summarize(gappy, ["k"], "v", "t", "id", rows_per_chunk=limit).toPandas().set_index("k").loc[0]
    p = pdf[pdf.k == 0]
    x = p.v.where(p.id % 5 != 0).dropna()
    assert got["mean"] == pytest.approx(x.mean()) and got["std"] == pytest.approx(x.std()) and got["median"] == pytest.approx(x.median())
    assert got["skew"] == pytest.approx(x.skew()) and got["kurtosis"] == pytest.approx(x.kurt())
    assert got["num_missing"] == 180 and got["missing_ratio"] == pytest.approx(0.2)
    t = p.t[x.index]
    assert got["slope"] == pytest.approx((x.iloc[-1] - x.iloc[0]) / (t.iloc[-1] - t.iloc[0]))


def test_reference_moments(spark):
    pdf = pd.DataFrame({"k": 1, "t": np.arange(6.0), "id": np.arange(6), "v": [1.0, 2, 4, 8, 16, 3]})
    got = signal.summarize(spark.createDataFrame(pdf), ["k"], "v", "t", "id").first()
    assert got["skew"] == pytest.approx(1.60026, abs=1e-5) and got["kurtosis"] == pytest.approx(2.33567, abs=1e-5)
    assert got["median"] == 3.5 and got["iqr"] == 4.75


@pytest.mark.parametrize("limit", [100, 100_000])
def test_welch(waves, spark, limit):
    pdf, df = waves
    fs = spark.createDataFrame([(0, 10.0), (1, 10.0), (2, 10.0), (3, 10.0)], "k long, fs double")
    got = signal.welch_psd(df, ["k"], ["t", "id"], "v", fs, rows_per_chunk=limit).toPandas()
    for k, n in ((0, 256), (1, 60)):
        x = pdf[pdf.k == k].v.to_numpy()
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        segs = [x[s : s + n] for s in range(0, len(x) - n + 1, n - n // 2)]
        p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * w)) ** 2 for s in segs], axis=0) / (10 * (w * w).sum())
        p[1:-1] *= 2
        g = got[got.k == k].sort_values("bin")
        np.testing.assert_allclose(g.psd, p, atol=1e-9)
        np.testing.assert_allclose(g.freq, np.arange(n // 2 + 1) * 10 / n)


def test_asof_and_excerpt(spark):
    l = spark.createDataFrame([(1, 1.0, 10), (1, 5.0, 11), (2, 1.0, 12)], "k long, t double, id long")
    r = spark.createDataFrame([(1, 0.5, 1, 7.0), (1, 1.0, 2, 8.0), (2, 3.0, 3, 9.0)], "k long, t double, id long, v double")
    for limit in (None, 2):
        got = {x.id: x.right_v for x in joins.asof_align(l, r, ["k"], "t", ["v"], "id", 2.0, rows_per_chunk=limit).collect()}
        assert got == {10: 8.0, 11: None, 12: None}


@pytest.mark.parametrize("p, block", [(2, 20_000), (1, 20_000), (2, 17)])
def test_knn_is_exact(spark, p, block):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(260, 4)), 2)
    x[:90] = x[0] + np.round(rng.normal(scale=0.01, size=(90, 4)), 4)  # one crowded spot
    pdf = pd.DataFrame({"id": np.arange(260), "x": x.tolist(), "y": np.arange(260) % 4})
    df = spark.createDataFrame(pdf)
    test, train = df.where("id % 4 = 0"), df.where("id % 4 <> 0")
    got = joins.knn_join(test, train, "id", "x", "y", 5, p, block).toPandas().sort_values(["id", "nth"])
    ids = np.arange(260)
    tr = ids[ids % 4 != 0]
    for q in ids[ids % 4 == 0]:
        d = np.abs(x[tr] - x[q])
        d = d.sum(1) if p == 1 else np.sqrt((d * d).sum(1))
        assert got[got.id == q].neighbor.tolist() == tr[np.lexsort((tr, d))[:5]].tolist()


@pytest.mark.parametrize("p", [1, 2])
def test_knn_measures_few_rows_exactly_and_keeps_ties(p, monkeypatch):
    rng = np.random.default_rng(6)
    measure, measured = joins._distances, []
    monkeypatch.setattr(joins, "_distances", lambda a, b, q: measured.append(len(a) * len(b)) or measure(a, b, q))
    odd = rng.normal(size=(900, 3))
    odd[5, 1], odd[7, 2] = np.nan, np.inf
    spread = rng.normal(size=(4000, 16))
    for known, some in [
        (spread, 0.05), (np.round(rng.normal(size=(4000, 2)), 1), 0.5), (spread + 1e6, 1), (np.repeat(spread[:8], 500, axis=0), 0.5),
        (spread * 1e200, 1), (spread * 1e-200, 1), (np.zeros((600, 2)), 1), (odd, 1), (spread[:6], 1),
    ]:
        asked = known[::97]
        with np.errstate(all="ignore"):
            d = measure(asked, known, p)
            measured.clear()
            top, near = joins._nearest(asked, known, p, 7)
        want = np.argsort(d, axis=1, kind="stable")[:, :7]
        assert (top == want).all()
        np.testing.assert_array_equal(near, np.take_along_axis(d, want, axis=1))
        assert sum(measured) <= some * d.size  # before, all were measured and sorted


def test_validated_join_fails_inside_the_plan(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b")], "k long, a string")
    r = spark.createDataFrame([(1, "x"), (1, "y")], "k long, b string")
    assert joins.join_validated(r, l, ["k"], "many_to_one").count() == 2
    with pytest.raises(PySparkException):
        joins.join_validated(l, r, ["k"], "one_to_one").collect()


def greedy(sizes, k):
    loads, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        f = loads.index(min(loads))
        loads[f] += n
        out[g] = f + 1
    return out


def test_group_kfold_matches_the_plain_walk(spark):
    rng = np.random.default_rng(1)
    sizes = {0: 4000, **{i: int(rng.integers(1, 12)) for i in range(1, 400)}}
    pdf = pd.DataFrame({"g": np.repeat(list(sizes), list(sizes.values()))})
    got = {r.g: r.fold for r in folds.group_kfold(spark.createDataFrame(pdf), "g", 5).collect()}
    assert got == greedy(sizes, 5)


def test_nested_folds_leave_out_the_outer_fold(spark):
    pdf = pd.DataFrame({"g": np.repeat(np.arange(20), 3)})
    pdf["own"] = pdf.g % 5 + 1
    got = folds.nested_folds(spark.createDataFrame(pdf), "g", "own", 5, 3).toPandas()
    assert len(got) == 80 and not ((got.g % 5 + 1) == got.outer_fold).any()
    assert got.groupby("outer_fold").inner_fold.nunique().eq(3).all()


def test_preparation_sees_training_rows_only(spark, sf):
    from cohortloom.plans.preparation import folded

    base = folded(spark, sf).where("pos < 6").cache()
    shifted = base.withColumn("value", F.when(F.col("fold") == 2, F.col("value") + 1e4).otherwise(F.col("value")))

    def state(df):
        s = prep.fit(df, "fold", 5, "target_class", "target_score").where("outer_fold = 2")
        return s.select("feature", "median", "mean", "sd", "anova_f", "corr_f").toPandas().sort_values("feature").reset_index(drop=True)

    pd.testing.assert_frame_equal(state(base), state(shifted))


def test_a_copy_of_the_target_ranks_first(spark):
    rows = [(i, i % 5 + 1, i % 4, float(i % 4 + 1), f, p, float(i % 4 + 1) if f == "copy" else float(i * 7 % 13)) for i in range(80) for p, f in enumerate(("noise", "copy"))]
    long = spark.createDataFrame(rows, "id long, fold long, y int, score double, feature string, pos int, value double")
    state = prep.fit(long, "fold", 5, "y", "score")
    for score in ("anova_f", "corr_f"):
        assert {r.feature for r in prep.select(state, score, 1).collect()} == {"copy"}


def test_metrics_survive_unknown_labels(spark):
    df = spark.createDataFrame([(0, 9, 9)], "k int, y_true int, y_pred int")
    got = metrics.classification_metrics(df, ["k"]).first()
    assert got.rows == 1 and got.macro_f1 == 0 and got.balanced_accuracy is None


def test_quantizer_clips_to_the_fitted_range(spark):
    lo, hi = F.lit(0.0), F.lit(4.0)
    row = spark.range(1).select(*[prep.quantize_level(F.lit(v), lo, hi, 5).alias(f"c{i}") for i, v in enumerate((-1.0, 5.0, 4.0, 1.9))], prep.quantize_level(F.lit(3.0), hi, hi, 5)).first()
    assert list(row) == [0, 4, 4, 2, 0]


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    t, p = rng.integers(0, 3, 500), rng.integers(0, 4, 500)
    got = metrics.classification_metrics(spark.createDataFrame(pd.DataFrame({"k": 0, "y_true": t, "y_pred": p})), ["k"]).first()
    f1 = [2 * ((t == c) & (p == c)).sum() / max(1, (t == c).sum() + (p == c).sum()) for c in range(4)]
    assert got.macro_f1 == pytest.approx(np.mean(f1)) and got.accuracy == pytest.approx((t == p).mean())
    recall = [((t == c) & (p == c)).sum() / (t == c).sum() for c in range(3)]
    assert got.balanced_accuracy == pytest.approx(np.mean(recall))
    o = np.zeros((4, 4))
    np.add.at(o, (t, p), 1)
    w = (np.arange(4)[:, None] - np.arange(4)) ** 2
    assert got.quadratic_weighted_kappa == pytest.approx(1 - (w * o).sum() / (w * np.outer(o.sum(1), o.sum(0)) / 500).sum())


def seed_rows(seeds):
    rows = [(1, s, [0.1, 0.4 + 0.1 * i, 0.45, 0.0], 5.0 - i, 1, 2.0) for i, s in enumerate(seeds)]
    return rows, "run long, seed int, scores array<double>, y_pred_raw double, y_true int, target_score double"


def test_canonicalize_averages_then_decides(spark):
    df = spark.createDataFrame(*seed_rows([42, 43]))
    got = metrics.canonicalize(df, ["run"], [42, 43]).first()
    assert got.y_pred == 1 and got.y_pred_raw == 4.5 and got.y_pred_bounded == 4.0
    for seeds in ([42], [42, 43, 43], [42, 44]):
        with pytest.raises(PySparkException):
            metrics.canonicalize(spark.createDataFrame(*seed_rows(seeds)), ["run"], [42, 43]).collect()


@pytest.mark.parametrize("limit", [20, None])
def test_spearman_with_ties(spark, limit):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": 0, "a": rng.integers(0, 6, 300).astype(float), "b": rng.integers(0, 9, 300).astype(float)})
    got = metrics.spearman(spark.createDataFrame(pdf), ["k"], "a", "b", rows_per_chunk=limit).first().spearman
    assert got == pytest.approx(pdf.a.rank().corr(pdf.b.rank()))


def test_holm_is_monotone_and_bounded(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.04, 0.001, 0.03, 0.20, 0.05])], "family string, i int, p double")
    got = stats.holm(df, ["family"], "p", "i").toPandas().sort_values("p")
    assert got.p_holm.is_monotonic_increasing and got.p_holm.max() <= 1
    assert got.set_index("i").p_holm[1] == pytest.approx(0.005)


def test_rank_biserial_signs(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0)] + [("b", -v) for v in (1.0, 2.0, 3.0)] + [("c", 0.0)] * 3
    s = stats.signed_ranks(spark.createDataFrame(rows, "k string, d double"), ["k"], "d")
    got = {r.k: (r.e, r.z) for r in s.select("k", stats.rank_biserial().alias("e"), stats.rank_biserial(0.0).alias("z")).collect()}
    assert got == {"a": (1.0, 1.0), "b": (-1.0, -1.0), "c": (None, 0.0)}


@pytest.mark.parametrize("clustered", [True, False])
def test_bootstrap_draws_are_not_broadcast(spark, monkeypatch, clustered):
    seen, sums = [], stats.resampled_sums
    monkeypatch.setattr(stats, "resampled_sums", lambda units, *rest: seen.append(units) or sums(units, *rest))
    if clustered:
        df = spark.createDataFrame([("m", u, u % 4, (u + u % 3) % 4) for u in range(30)], "m string, u long, y_true int, y_pred int")
        stats.cluster_bootstrap(df, ["m"], "u", "macro_f1", reps=20).collect()
    else:
        df = spark.createDataFrame([("m", u, float(u % 7)) for u in range(30)], "m string, u long, v double")
        stats.bootstrap_ci(df, ["m"], "u", "v", reps=20).collect()
    seen[0].collect()  # the joins are picked as it runs
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("_i#" in line or "[u#" in line)]
    assert "_reps" in plan and not sent


def test_bootstrap_of_a_constant_and_repeatability(spark):
    df = spark.createDataFrame([(0, i, 2.5) for i in range(35)] + [(1, i, float(i)) for i in range(35)], "k int, u int, v double")
    a, b = (stats.bootstrap_ci(df, ["k"], "u", "v", reps=200).toPandas().sort_values("k").reset_index(drop=True) for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    assert a.ci_low[0] == a.ci_high[0] == 2.5
    assert a.ci_low[1] < 17 < a.ci_high[1]


def test_friedman(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 5, (30, 4)).astype(float)
    rows = [(0, i, f"c{j}", float(v[i, j])) for i in range(30) for j in range(4)]
    got = stats.friedman(spark.createDataFrame(rows, "k int, u int, c string, v double"), ["k"], "u", "c", "v", ["c0", "c1", "c2", "c3"]).first()
    ranks = pd.DataFrame(v).rank(axis=1).to_numpy()
    ties = sum((n**3 - n) for row in v for n in np.unique(row, return_counts=True)[1])
    chi = (12 / (30 * 4 * 5) * (ranks.sum(0) ** 2).sum() - 3 * 30 * 5) / (1 - ties / (30 * 4 * 15))
    assert got.statistic == pytest.approx(chi)


def test_pareto_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": 0, "id": np.arange(150), "c": rng.integers(0, 20, 150), "g": rng.integers(0, 20, 150), "b": rng.integers(0, 3, 150)})
    df = spark.createDataFrame(pdf)

    def beaten(r, use):
        better = (pdf.c <= r.c) & (pdf.g >= r.g)
        strict = (pdf.c < r.c) | (pdf.g > r.g)
        if use:
            better, strict = better & (pdf.b <= r.b), strict | (pdf.b < r.b)
        return (better & strict).any()

    for level in (None, "b"):
        got = {r.id for r in tables.pareto_front(df, ["k"], "c", "g", level).collect()}
        assert got == {r.id for r in pdf.itertuples() if not beaten(r, level)}


def toy(spark):
    rng = np.random.default_rng(8)
    x = rng.choice([-1, 1], size=(32, 24))
    y = np.repeat(np.arange(4), 8)
    for c in range(4):
        x[y == c, 4 * c : 4 * c + 4] = 1
        x[y != c, 4 * c : 4 * c + 4] = -1
    pdf = pd.DataFrame({"s": 1, "id": np.arange(32), "y": y.astype("int32"), "hv": x.astype("int8").tolist()})
    return pdf, spark.createDataFrame(pdf, "s int, id long, y int, hv array<tinyint>")


@pytest.mark.parametrize("per_class", [1, 2])
def test_online_learning_in_chunks_equals_one_walk(spark, per_class):
    pdf, df = toy(spark)
    if per_class == 1:
        start = hdc.unit_prototypes(hdc.prototypes(df, ["s"], "y", "hv"), ["s"])
    else:
        start = hdc.centroid_state(hdc.fit_multicentroid(df, "y", "hv", 2, 42)).withColumn("s", F.lit(1))
    start = spark.createDataFrame(start.select("s", "state").collect(), "s int, state array<double>")
    one = hdc.fit_online(df, start, ["s"], "id", "y", "hv", 2, 0.1, 0.9, 42, per_class).first()
    cut = hdc.fit_online(df, start, ["s"], "id", "y", "hv", 2, 0.1, 0.9, 42, per_class, chunk_rows=7).first()
    np.testing.assert_allclose(one.state, cut.state)
    assert one.updates == cut.updates > 0
    m = np.array(one.state).reshape(4 * per_class, 24)
    np.testing.assert_allclose(np.linalg.norm(m, axis=1), 1.0)
    s = df.withColumn("sc", hdc.cosine_scores(F.col("hv"), F.lit(0), {None: m}, per_class)).toPandas()
    assert np.mean(np.stack(s.sc).argmax(1) == s.y) >= 0.75


def test_one_update_pulls_and_pushes():
    model = np.zeros((4, 3)) + np.array([[0.1, 0, 0], [0, 0.1, 0], [0.2, 0, 0.2], [0, 0, 0.1]])
    x = np.array([1.0, -1, 1])
    before = model.copy()
    assert hdc._visit(model, np.arange(4), x, 1, 0.1, 0.0, True)
    assert model[1] @ x > before[1] @ x and model[2] @ x < before[2] @ x
    assert np.array_equal(model[[0, 3]], before[[0, 3]])


def test_encoder_prefixes_equal_the_plain_sum(spark):
    from cohortloom.functions import vectors as hv

    rng = np.random.default_rng(9)
    lv = rng.integers(0, 5, (40, 6))
    names = [f"f{i}" for i in range(6)]
    rank = [3, 0, 5, 1, 4, 2]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(40), "lv": lv.tolist()}))
    got = df.select("id", hdc.encode_prefixes(F.col("lv"), names, rank, [2, 6], 5, 1, 50).alias("p")).toPandas().sort_values("id")
    ident = np.stack([hv.bipolar(1, "feature_identity", n, 50) for n in names]).astype(int)
    book, tie = hv.level_codebook(1, 5, 50).astype(int), hv.bipolar(1, "bundle_tie", "shared", 50)
    for k in (2, 6):
        total = sum(ident[f] * book[lv[:, f]] for f in rank[:k])
        want = np.where(total == 0, tie, np.sign(total))
        assert np.array_equal(np.stack([np.asarray(p[f"k{k}"]) for p in got.p]), want)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(10)
    x = rng.choice([-1, 1], size=(80, 6))
    y = x @ rng.normal(size=6) + rng.normal(size=80)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(80), "hv": x.tolist(), "y": y}))
    model = hdc.fit_ridge(df, "hv", "y", 1.0, 6)
    z = x / np.sqrt(6)
    zc, yc = z - z.mean(0), y - y.mean()
    w = np.linalg.solve(zc.T @ zc + np.eye(6), zc.T @ yc)
    np.testing.assert_allclose(model.coefficients.toArray(), w, atol=1e-5)


def test_elastic_net_meets_its_optimality_conditions(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 5))
    y = 3 * (x @ [2.0, -1.0, 0, 0, 0.5]) + rng.normal(size=200)
    alpha, mix = 0.4, 0.5
    df = models.frame(spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "y": y})), "x", "y")
    m = models.elastic_net(df, alpha, mix, 5)
    w = m.coefficients.toArray()
    g = -x.T @ (y - x @ w - m.intercept) / 200 + alpha * (1 - mix) * w
    for wi, gi in zip(w, g):
        assert abs(gi + alpha * mix * np.sign(wi)) < 1e-3 if wi else abs(gi) <= alpha * mix + 1e-3


def test_logistic_penalty_follows_c(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + rng.normal(size=240) > 0).astype(int) + (x[:, 1] > 1)
    df = models.frame(spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "y": y})), "x", "y")
    m = models.logistic(df, 0.5)
    w, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    z = np.exp(x @ w.T + b)
    gap = z / z.sum(1, keepdims=True) - np.eye(3)[y]
    np.testing.assert_allclose(gap.T @ x + w / 0.5, 0, atol=0.05)


def test_linear_svr_recovers_a_line(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "y": x @ [1.5, -0.5] + 2}))
    w, b = models.linear_svr(df, "x", "y", c=100.0, epsilon=0.05, epochs=60)
    np.testing.assert_allclose([*w, b], [1.5, -0.5, 2], atol=0.15)


def test_gates_fail_closed(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert audit.assert_gates(df, {"some": F.count(F.lit(1)) > 0}).first().passed
    with pytest.raises(PySparkException):
        audit.assert_gates(df, {"none": F.count(F.lit(1)) == 0}).collect()


def test_change_containment_reports_violations(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)], "run int, f string, v double")
    after = spark.createDataFrame([(1, "a", None), (2, "a", None), (4, "a", 3.0)], "run int, f string, v double")
    ok = spark.createDataFrame([(1,)], "run int")
    got = {r.fate: r.cells for r in audit.assert_changes(before, after, ["run", "f"], "v", ok, ["run"]).collect()}
    assert got == {"allowed_blanked": 1, "violation_changed": 1, "violation_row_added": 1, "violation_row_removed": 1}


def test_table_hash_ignores_order_and_sees_changes(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 3)
    a = audit.table_hash(df).first()
    assert a == audit.table_hash(df.orderBy(F.col("id").desc()).repartition(7)).first()
    assert a != audit.table_hash(df.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v")))).first()


def test_frozen_table(spark, tmp_path):
    df, path = spark.range(10), str(tmp_path / "frozen")
    assert versions.publish_once(df, path) == "CREATED"
    assert versions.publish_once(df.orderBy(F.col("id").desc()), path) == "REUSED"
    with pytest.raises(ValueError):
        versions.publish_once(spark.range(11), path)


def test_schedule_variance_kinds(spark):
    rows = [("s", l, r) for l, r in audit.EXPECTED_SCHEDULE if r not in ("001", "002")] + [("s", "04B", "001"), ("s", "09B", "099")]
    got = {(r.level, r.run, r.status) for r in audit.schedule_variance(spark.createDataFrame(rows, "s string, l string, r string"), "s", "l", "r").collect()}
    assert got == {("01B", "001", "schedule_mapping_hole"), ("03B", "002", "physically_absent_run"), ("04B", "001", "unexpected"), ("09B", "099", "unexpected")}


def test_checks_hold_when_their_columns_are_not_asked_for(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    once = spark.createDataFrame([(1, "c")], "k int, y string")
    for ask in (lambda df: df.select("y").collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="duplicate key"):
            ask(joins.join_validated(once, twice, ["k"], "one_to_one"))
    pairs = spark.createDataFrame([(1, "l", 1.0), (1, "l", 2.0), (1, "r", 3.0)], "u int, c string, v double")
    for ask in (lambda df: df.select("right_value").collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="repeated unit"):
            ask(joins.paired(pairs, ["u"], "c", "l", "r", "v"))
    seeds = spark.createDataFrame(*seed_rows([42, 42, 99]))
    for ask in (lambda df: df.select("y_pred").collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="expected seeds"):
            ask(metrics.canonicalize(seeds, ["run"], [42, 43]))
    with pytest.raises(Exception, match="gate failed"):
        audit.assert_gates(once, {"none": F.count(F.lit(1)) == 0}).count()


def test_absent_class_is_refused(spark):
    protos = spark.createDataFrame([(0, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "label int, prototype array<double>")
    with pytest.raises(ValueError, match="no prototype"):
        hdc.model_arrays(protos, None)


def test_first_and_last_sample_of_day_numbers(spark):
    day = 738000.5
    rows = [("s", day + 4e-8, 1, 5.0), ("s", day, 2, 3.0), ("s", day + 9e-8, 0, 7.0)]
    df = spark.createDataFrame(rows, "k string, t double, row_id long, v double")
    key = ordered.order_key("t", "row_id")
    first, last = df.agg(F.min_by("v", key), F.max_by("v", key)).first()
    assert (first, last) == (3.0, 7.0)


def test_swapped_csv_header_fails(spark, tmp_path):
    from cohortloom.sources import files

    (tmp_path / "a.csv").write_text("t,ecg,eda\n1,2,3\n")
    assert files.read_stream_files(spark, str(tmp_path), ["t", "ecg", "eda"]).first().eda == "3"
    (tmp_path / "b.csv").write_text("t,eda,ecg\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_stream_files(spark, str(tmp_path), ["t", "ecg", "eda"]).collect()


def test_many_seeds_are_told_apart(spark):
    seeds = list(range(100, 230))
    rows, schema = seed_rows(seeds)
    rows = [(run, seed, [0.1, 0.4, 0.45, 0.0], raw, y, t) for run, seed, _, raw, y, t in rows]
    assert metrics.canonicalize(spark.createDataFrame(rows, schema), ["run"], seeds).count() == 1
    for wrong in (rows[:-1] + [rows[0]], rows[:-1], rows + [rows[3]], rows[1:] + [(1, 999, *rows[0][2:])]):
        with pytest.raises(Exception, match="expected seeds"):
            metrics.canonicalize(spark.createDataFrame(wrong, schema), ["run"], seeds).collect()


def test_schedules_of_tasks(spark):
    rows = [("s", "rest", "000", "001"), ("s", "rest", "001", "002"), ("s", "walk", "000", "001"), *[("s", "ils", l, r) for l, r in audit.EXPECTED_SCHEDULE]]
    got = audit.task_schedule_variance(spark.createDataFrame(rows, "s string, task string, l string, r string"), "s", "task", "l", "r").collect()
    assert {(r.task, r.level, r.run, r.status) for r in got} == {
        ("rest", "000", "002", "schedule_mapping_hole"), ("rest", "001", "002", "unexpected"), ("walk", "000", "001", "unexpected"),
    }


@pytest.mark.parametrize("columns, found", [
    (["FixationSeq"], ["eye_tracking"]), (["fixationseq2"], []), (["total_error "], ["performance"]), (["my_total_error"], []),
    (["left_stick_position", "aircraft_rudder_trim"], ["control_input", "xplane"]), (["aircraft_pitch"], ["xplane"]), ([], []), (None, []),
])
def test_evidence_of_column_names(spark, columns, found):
    from cohortloom.functions import names

    df = spark.createDataFrame([(columns,)], "c array<string>")
    assert df.select(names.modality_evidence(F.col("c")).alias("e")).first().e == found


def test_nested_predictions_lay_out_both_sides_in_one_pass_from_a_settled_state(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cells = {(i, f): None if f == 2 and i % 5 == 0 else float(rng.normal(i % 2, 1)) for i in range(40) for f in range(3)}
    rows = [(i, f"f{f}", f, x, None if i == 39 else i % 3 + 1, i % 2, float(i % 4)) for (i, f), x in cells.items()]
    long = spark.createDataFrame(rows, "ident long, feature string, pos int, value double, fold int, label int, target double")
    plans, seen = [], []
    transform = models.prep.transform
    monkeypatch.setattr(models.prep, "transform", lambda r, s, f: plans.append(s._jdf.queryExecution().optimizedPlan().toString()) or transform(r, s, f))

    class First:
        def transform(self, df):
            return df.withColumn("prediction", F.get("x", F.lit(0)))

    def fit(train):
        seen.append({r["ident"]: r["x"] for r in train.collect()})
        return First()

    got = {(r["outer_fold"], r["ident"]): r["y_pred"] for r in models.nested_predictions(long, "fold", 3, "label", "target", "ident", "all", fit).collect()}
    assert len(plans) == 1 and "Aggregate" not in plans[0]  # before, two passes, and the state was fitted anew in each
    assert sorted(got) == sorted((i % 3 + 1, i) for i in range(39))
    for f in range(1, 4):
        train = [i for i in range(39) if i % 3 + 1 != f]
        assert sorted(seen[f - 1]) == train
        want = []
        for j in range(3):
            known = [cells[i, j] for i in train if cells[i, j] is not None]
            full = {i: np.median(known) if cells[i, j] is None else cells[i, j] for i in range(39)}
            want.append({i: (full[i] - np.mean([full[t] for t in train])) / np.std([full[t] for t in train]) for i in range(39)})
        gap = {i: float(cells[i, 2] is None) for i in range(39)}
        want.append({i: (gap[i] - np.mean([gap[t] for t in train])) / np.std([gap[t] for t in train]) for i in range(39)})
        for i in train:
            assert np.allclose(sorted(seen[f - 1][i]), sorted(w[i] for w in want))
        for i in set(range(39)) - set(train):
            assert any(np.isclose(got[f, i], w[i]) for w in want)


def test_scores_of_a_large_batch_hold_few_rows_as_doubles(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(11)
    x = rng.choice([-1, 1], (10_000, 256)).astype(np.int8)
    keys = rng.integers(1, 3, len(x))
    model = {k: rng.normal(size=(8, 256)) for k in (1, 2)}
    monkeypatch.setattr(hdc.F, "pandas_udf", lambda schema: lambda f: f)
    vectors, which = pd.Series(list(x)), pd.Series(keys)
    tracemalloc.start()
    got = hdc.cosine_scores(vectors, which, model, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6  # before, the whole batch as doubles several times, 41 MB
    unit = {k: m / np.linalg.norm(m, axis=1, keepdims=True) for k, m in model.items()}
    want = [(unit[k] @ (v / np.linalg.norm(v.astype(float)))).reshape(4, 2).max(axis=1) for v, k in zip(x, keys)]
    assert np.allclose(np.stack(got), want)
