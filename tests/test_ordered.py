"""Hot keys are split into ranges; results must equal the plain single-group computation."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n)).astype("int64"),
            "t": rng.integers(0, 500, n).astype("float64"),
            "id": np.arange(n),
            "v": np.round(rng.normal(size=n), 1),
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


def sorted_pdf(pdf):
    return pdf.sort_values(["k", "t", "id"]).reset_index(drop=True)


def test_chunks_split_only_hot_keys(skewed):
    pdf, df = skewed
    got = ordered.range_chunks(df, ["k"], ["t", "id"], 100).toPandas()
    per = got.groupby(["k", "_chunk"], dropna=False).size()
    assert got[got.k == 0]._chunk.nunique() > 4
    assert per.max() < 500
    spans = got[got.k == 0].groupby("_chunk").t.agg(["min", "max"]).sort_index()
    assert (spans["min"].to_numpy()[1:] >= spans["max"].to_numpy()[:-1]).all()


@pytest.mark.parametrize("limit", [100, 10_000])
@pytest.mark.parametrize("offset", [-1, 1])
def test_neighbor(skewed, limit, offset):
    pdf, df = skewed
    got = sorted_pdf(ordered.with_neighbor(df, ["k"], ["t", "id"], {"near": "v"}, offset, limit).toPandas())
    want = sorted_pdf(pdf)
    want["near"] = want.groupby("k").v.shift(-offset)
    pd.testing.assert_series_equal(got.near, want.near)


@pytest.mark.parametrize("limit", [100, 10_000])
def test_running(skewed, limit):
    pdf, df = skewed
    got = sorted_pdf(
        ordered.running(df, ["k"], ["t", "id"], {"s": ("sum", "v"), "m": ("max", "v"), "l": ("min", "v")}, rows_per_chunk=limit).toPandas()
    )
    want = sorted_pdf(pdf)
    np.testing.assert_allclose(got.s, want.groupby("k").v.cumsum(), atol=1e-9)
    np.testing.assert_allclose(got.m, want.groupby("k").v.cummax())
    np.testing.assert_allclose(got.l, want.groupby("k").v.cummin())


@pytest.mark.parametrize("ordered_step", [
    lambda d: ordered.with_neighbor(d, ["user_id"], ["ts", "event_id"], {"p": "value"}),
    lambda d: ordered.running(d, ["user_id"], ["ts", "event_id"], {"p": ("sum", "value")}),
    lambda d: ordered.exact_quantiles(d, ["user_id"], "value", [0.5]),
])
def test_plan_does_not_depend_on_the_input_size(spark, sf, ordered_step):
    import re

    def shape(times):
        d = spark.read.parquet(*[f"{sf}/events.parquet"] * times)
        plan = ordered_step(d)._jdf.queryExecution().optimizedPlan().toString()
        return re.findall(r"^[\s:+-]*([A-Z]\w+)", plan, re.M)

    assert shape(1) == shape(40)


def test_running_last_and_global_row_number(skewed):
    from pyspark.sql import functions as F

    pdf, df = skewed
    marked = df.withColumn("x", F.when(F.col("id") % 7 == 0, F.col("v")))
    got = sorted_pdf(ordered.running(marked, ["k"], ["t", "id"], {"l": ("last", "x")}, rows_per_chunk=100).toPandas())
    want = sorted_pdf(pdf)
    want["x"] = want.v.where(want.id % 7 == 0)
    pd.testing.assert_series_equal(got.l, want.groupby("k").x.ffill(), check_names=False)
    rn = ordered.row_numbers(df, [], ["t", "id"], rows_per_chunk=200).toPandas().sort_values(["t", "id"])
    assert rn.rn.tolist() == list(range(1, len(pdf) + 1))


@pytest.mark.parametrize("limit", [50, 10_000])
def test_quantiles_and_ranks(skewed, limit):
    pdf, df = skewed
    got = ordered.exact_quantiles(df, ["k"], "v", [0.25, 0.5, 0.99], rows_per_chunk=limit).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, "quantiles"], np.percentile(g.v, [25, 50, 99]), atol=1e-12)
    ranks = ordered.average_ranks(df, ["k"], "v", rows_per_chunk=limit).toPandas()
    want = pdf.assign(r=pdf.groupby("k").v.rank()).groupby(["k", "v"]).r.first().reset_index()
    both = ranks.merge(want, on=["k", "v"])
    assert len(both) == len(ranks) == len(want)
    np.testing.assert_allclose(both.avg_rank, both.r)


def test_order_key_orders_any_times(spark):
    rng = np.random.default_rng(6)
    base = [0.0, -0.0, 1.0, 2.0, 0.5, 1.7e12, 1.7e18, 1e-30, 1e300, 5e-324, 86400.0, 719529.25]
    times = base + [float(np.nextafter(x, d)) for x in base for d in (-np.inf, np.inf)] + [-x for x in base] + [float(2.0**k) for k in range(-60, 60)]
    times += [float(np.nextafter(2.0**k, 0)) for k in range(-60, 60)] + rng.normal(size=200).tolist() + (1.7e12 + rng.integers(0, 50, 60)).tolist()
    rows = [(t, int(n)) for t in times for n in (0, 3, 10**18 - 1)]
    df = spark.createDataFrame(rows, "t double, n long").withColumn("k", ordered.order_key("t", "n"))
    got = [(r.t, r.n) for r in df.orderBy("k").collect()]
    near = lambda t: 0.0 if abs(t) < 2.0**-500 else float(np.clip(t, -(2.0**500), 2.0**500))
    assert [(near(t), n) for t, n in got] == sorted((near(t), n) for t, n in rows)


def test_order_key_takes_epoch_milliseconds(spark):
    df = spark.createDataFrame([("a", 1.7e12 + i, i, float(i)) for i in range(20)], "g string, t double, n long, v double")
    key = ordered.order_key("t", "n")
    row = df.groupBy("g").agg(F.min_by("v", key).alias("first"), F.max_by("v", key).alias("last")).first()
    assert (row["first"], row["last"]) == (0.0, 19.0)
