"""Classical models on Spark ML, with the penalty scalings of the usual C / alpha parameters."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import session
from cohortloom.functions.numeric import bound

from . import ordered, prep


def frame(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Columns for Spark ML beside the originals: features (vector), label (double)."""
    return df.withColumn("features", array_to_vector(F.col(vec))).withColumn("label", F.col(label).cast("double"))


def logistic(train: DataFrame, c: float = 1.0):
    n = train.count()
    return LogisticRegression(family="multinomial", regParam=1 / (c * n), standardization=False, maxIter=100).fit(train)


def linear_svm(train: DataFrame, c: float = 1.0):
    """One hinge-loss machine per class against the rest."""
    n = train.count()
    return OneVsRest(classifier=LinearSVC(regParam=1 / (c * n), standardization=False, maxIter=50)).fit(train)


def binary_svm(train: DataFrame, c: float = 1.0):
    n = train.count()
    return LinearSVC(regParam=1 / (c * n), standardization=False, maxIter=50).fit(train)


def boosted_classifier(train: DataFrame, rounds: int = 100, rate: float = 0.1, depth: int = 2, seed: int = 42):
    """Spark boosts two classes at a time, so one booster per class against the rest."""
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed)).fit(train)


def boosted_regressor(train: DataFrame, rounds: int = 100, rate: float = 0.1, depth: int = 2, seed: int = 42):
    return GBTRegressor(maxIter=rounds, stepSize=rate, maxDepth=depth, lossType="squared", seed=seed).fit(train)


GRAM_LIMIT = 4096  # widest input for which Spark sums a features x features matrix


def penalized_regression(train: DataFrame, l1: float, l2: Callable[[int], float], dim: int):
    """Least squares / (2n) + l1 |w| + l2(n) |w|^2 / 2, no penalty on the intercept.

    Spark scales the label to unit spread before it applies ``regParam``, which leaves the l1 part
    as given and divides the l2 part by the label's spread; both are set here to cancel that.
    """
    n, pop, samp = train.agg(F.count(F.lit(1)), F.stddev_pop("label"), F.stddev_samp("label")).first()
    exact = dim <= GRAM_LIMIT
    ridge_part = l2(n) * (pop if exact else samp)
    total = l1 + ridge_part
    return LinearRegression(
        regParam=total, elasticNetParam=l1 / total if total else 0.0, standardization=False,
        solver="normal" if exact else "l-bfgs", maxIter=500, tol=1e-9,
    ).fit(train)


def ridge(train: DataFrame, alpha: float = 1.0, dim: int = 1):
    """Penalty ``alpha`` |w|^2 beside the sum of squared errors."""
    return penalized_regression(train, 0.0, lambda n: alpha / n, dim)


def elastic_net(train: DataFrame, alpha: float = 0.01, l1_ratio: float = 0.5, dim: int = 1):
    return penalized_regression(train, alpha * l1_ratio, lambda n: alpha * (1 - l1_ratio), dim)


def least_squares_on_components(train: DataFrame, components: int = 2):
    """Ordinary least squares on the first principal components."""
    return Pipeline(stages=[
        PCA(k=components, inputCol="features", outputCol="pcs"), LinearRegression(featuresCol="pcs", labelCol="label")
    ]).fit(train)


def linear_svr(train: DataFrame, vec: str, target: str, c: float = 1.0, epsilon: float = 0.1, epochs: int = 30) -> tuple[list[float], float]:
    """Linear regression under epsilon-insensitive loss, penalty 1 / (C n); returns (weights, intercept).

    Sub-gradient descent: an epoch is one grouped sum over all rows, and only the weights pass
    through the driver. The later half of the iterates is averaged.
    """
    data = train.select(F.col(vec).alias("x"), F.col(target).cast("double").alias("y")).cache()
    n, dim, start = data.agg(F.count(F.lit(1)), F.max(F.size("x")), F.avg("y")).first()
    w, b, lam = [0.0] * dim, start, 1 / (c * n)
    total_w, total_b, kept = [0.0] * dim, 0.0, 0
    for epoch in range(epochs):
        residual = F.col("y") - linear_value(F.col("x"), w, b)
        pull = F.when(F.abs(residual) > epsilon, F.signum(residual)).otherwise(0.0)
        moved = data.withColumn("_s", pull).select("_s", array_to_vector(F.transform("x", lambda v: v * F.col("_s"))).alias("_g"))
        g, gb = moved.agg(vector_to_array(Summarizer.mean(F.col("_g"))), F.avg("_s")).first()
        step = 1.0 / (1 + epoch) ** 0.5
        w = [wi - step * (lam * wi - gi) for wi, gi in zip(w, g)]
        b = b + step * gb
        if epoch >= epochs // 2:
            total_w, total_b, kept = [t + wi for t, wi in zip(total_w, w)], total_b + b, kept + 1
    data.unpersist()
    return [t / kept for t in total_w], total_b / kept


def linear_value(x: Column, weights: Sequence[float], intercept: float) -> Column:
    products = F.zip_with(x, F.array(*[F.lit(float(v)) for v in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(intercept)), lambda a, v: a + v)


def dummy(df: DataFrame, train: Column, label: str, target: str, ident: str, labels: Sequence[int], salt: str = "dummy") -> DataFrame:
    """Baseline predictions for every row: most frequent class, a draw by class share, mean and median target."""
    fit = df.where(train)
    counts = fit.agg(*[F.count(F.when(F.col(label) == c, 1)).alias(f"c{c}") for c in labels], F.avg(target).alias("mean"))
    med = ordered.exact_quantiles(fit, [], target, [0.5], "q").select(F.get("q", F.lit(0))).scalar()
    shares = counts.select(F.array(*[F.col(f"c{c}") for c in labels])).scalar()
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col(ident).cast("string"))), 1, 8), 16, 10).cast("long")
    out = df.withColumn("_c", shares)
    total = F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x)
    at = u % total
    below = [F.aggregate(F.slice("_c", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x) for i in range(len(labels))]
    drawn = F.lit(labels[-1])
    for c, upto in reversed(list(zip(labels, below))):
        drawn = F.when(at < upto, F.lit(c)).otherwise(drawn)
    frequent = F.element_at(F.array(*[F.lit(c) for c in labels]), F.array_position("_c", F.array_max("_c")).cast("int"))
    return out.select(
        ident, frequent.alias("most_frequent"), drawn.alias("stratified"), counts.select("mean").scalar().alias("mean_score"), med.alias("median_score")
    )


def assemble(long: DataFrame, keys: Sequence[str], rank: str, value: str) -> DataFrame:
    """Ranked long features back to one array per row."""
    packed = F.array_sort(F.collect_list(F.struct(rank, value)))
    return long.groupBy(*keys).agg(F.transform(packed, lambda s: s[value]).alias("x"))


def nested_predictions(
    long: DataFrame, fold: str, k: int, label: str, target: str, ident: str, top: int | str, fit: Callable[[DataFrame], object], score: str = "anova_f"
) -> DataFrame:
    """Out-of-fold predictions: impute, scale and select on each training side, fit, predict the held-out fold.

    The driver only submits one fit per fold; state, features and predictions stay distributed. The state is fitted once and,
    cut down to the chosen features (a row per fold and feature), broadcast; one pass lays out training and held-out rows.
    """
    session.checkpoint_dir(long.sparkSession)  # state and rows are read again and again, so they are cut from their lineage once
    state = prep.fit(long, fold, k, label, target).checkpoint()
    chosen = prep.select(state, score, top).select("outer_fold", "feature", "rank").checkpoint()
    used = F.broadcast(state.join(chosen, ["outer_fold", "feature"], "left_semi").checkpoint())
    copies = long.where(F.col(fold).isNotNull()).withColumn("outer_fold", F.explode(F.array(*[F.lit(i) for i in range(1, k + 1)])))
    copies = copies.select("outer_fold", "feature", "value", ident, label, target, (F.col(fold) == F.col("outer_fold")).alias("_held"))
    ready = prep.transform(copies, used, "outer_fold").join(F.broadcast(chosen), ["outer_fold", "feature"])
    x = assemble(ready, ["outer_fold", "_held", ident, label, target], "rank", "scaled").checkpoint()
    train_x, test_x = x.where(~F.col("_held")), x.where("_held")
    parts = []
    for f in range(1, k + 1):
        model = fit(frame(train_x.where(F.col("outer_fold") == f), "x", label))
        held = frame(test_x.where(F.col("outer_fold") == f), "x", label)
        parts.append(model.transform(held).select("outer_fold", ident, F.col(label).alias("y_true"), F.col("prediction").alias("y_pred")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def regression_output(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns, F.col("prediction").alias("prediction_raw"), bound(F.col("prediction"), 1.0, 4.0).alias("prediction_bounded"))
