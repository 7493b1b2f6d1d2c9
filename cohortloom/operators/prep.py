"""Fold-local preprocessing. All state comes from training rows and lives in small tables.

A fold's training set is every row outside it.  Counts, means and spreads of a training set are
merged from per-fold partials, so the data is read once and not once per fold; only the medians
look at each row k-1 times.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered, tables

INDICATOR = "missingindicator_"
AFTER_FEATURES = 1_000_000  # indicator positions follow every feature position


def train_copies(df: DataFrame, fold: str, k: int, out: str = "outer_fold") -> DataFrame:
    """Each row once per fold it trains."""
    others = F.filter(F.array(*[F.lit(i) for i in range(1, k + 1)]), lambda f: f != F.col(fold))
    return df.withColumn(out, F.explode(others))


def _partials(long: DataFrame, fold: str, label: str, target: str) -> DataFrame:
    x, y = F.col("value"), F.col(target)
    gap = x.isNull()
    return long.groupBy(F.col(fold).alias("_own"), "feature", "pos", F.col(label).alias("label")).agg(
        F.count("value").alias("n"), F.count(F.when(gap, 1)).alias("m"), F.avg("value").alias("mu"),
        (F.var_pop("value") * F.count("value")).alias("m2"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.sum(F.when(~gap, x * y)).alias("xy"), F.sum(F.when(~gap, y)).alias("y"), F.sum(F.when(gap, y)).alias("y_gap"), F.sum(y * y).alias("yy"),
    )


def fit(long: DataFrame, fold: str, k: int, label: str, target: str, rows_per_chunk: int | None = None) -> DataFrame:
    """State per (outer_fold, feature): median, moments after median imputation, range, class F and correlation F.

    A feature with no training value imputes to 0.  Features missing somewhere in training also
    get an indicator feature, placed after all original features.
    """
    medians = ordered.exact_quantiles(
        train_copies(long.select("feature", "value", fold), fold, k), ["outer_fold", "feature"], "value", [0.5], "_q", rows_per_chunk
    )
    parts = train_copies(_partials(long, fold, label, target), "_own", k)
    cell = parts.groupBy("outer_fold", "feature", "pos", "label").agg(
        *[F.sum(c).alias(c) for c in ("n", "m", "xy", "y", "y_gap", "yy")], F.sum(F.col("mu") * F.col("n")).alias("s"),
        F.sum("m2").alias("w2"), F.collect_list(F.struct("mu", "n")).alias("_means"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    cell = ordered.key_join(cell, medians, ["outer_fold", "feature"], "left").withColumn(
        "median", F.coalesce(F.get("_q", F.lit(0)), F.lit(0.0))
    )
    med, n, m = F.col("median"), F.coalesce("n", F.lit(0)), F.col("m")
    rows = n + m
    mean = (F.coalesce("s", F.lit(0.0)) + m * med) / rows
    # Spread inside a class: within-fold parts, between fold means, and the imputed copies.
    between = F.aggregate(
        "_means", F.lit(0.0), lambda a, p: a + F.coalesce(p["n"] * (p["mu"] - mean) * (p["mu"] - mean), F.lit(0.0))
    )
    within = F.coalesce("w2", F.lit(0.0)) + between + m * (med - mean) * (med - mean)
    share = m / rows
    y_gap = F.coalesce("y_gap", F.lit(0.0))
    plain = F.struct(
        F.col("feature").alias("feature"), F.col("pos").cast("long").alias("pos"), F.lit(False).alias("is_indicator"), med.alias("median"),
        F.col("lo").alias("lo"), F.col("hi").alias("hi"), m.alias("gaps"), mean.alias("mean"), within.alias("within"),
        (F.coalesce("xy", F.lit(0.0)) + med * y_gap).alias("xy"),
    )
    mark = F.struct(
        F.concat(F.lit(INDICATOR), "feature").alias("feature"), (F.col("pos") + AFTER_FEATURES).cast("long").alias("pos"), F.lit(True).alias("is_indicator"),
        F.lit(0.0).alias("median"), F.when(share == 1, 1.0).otherwise(0.0).alias("lo"), F.when(share > 0, 1.0).otherwise(0.0).alias("hi"), m.alias("gaps"),
        share.alias("mean"), (rows * share * (1 - share)).alias("within"), y_gap.alias("xy"),
    )
    both = cell.select(
        "outer_fold", "label", rows.alias("rows"), (F.coalesce("y", F.lit(0.0)) + y_gap).alias("y"), "yy", F.explode(F.array(plain, mark)).alias("_c")
    )
    return _scores(both.select("outer_fold", "label", "rows", "y", "yy", "_c.*"))


def _scores(cell: DataFrame) -> DataFrame:
    g = cell.groupBy("outer_fold", "feature", "pos", "is_indicator", "median").agg(
        F.sum("rows").alias("rows"), F.sum("gaps").alias("gaps"), (F.sum(F.col("mean") * F.col("rows")) / F.sum("rows")).alias("mean"),
        F.sum("within").alias("ssw"), F.collect_list(F.struct("mean", "rows")).alias("_classes"), F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.min("lo"), F.lit(0.0)).alias("qmin"), F.coalesce(F.max("hi"), F.lit(0.0)).alias("qmax"),
        F.sum("xy").alias("xy"), F.sum("y").alias("y"), F.sum("yy").alias("yy"),
    ).where(~F.col("is_indicator") | (F.col("gaps") > 0))
    mean = F.col("mean")
    ssb = F.aggregate("_classes", F.lit(0.0), lambda a, p: a + p["rows"] * (p["mean"] - mean) * (p["mean"] - mean))
    g = g.withColumn("ssb", ssb).drop("_classes")
    n, total = F.col("rows"), F.col("ssb") + F.col("ssw")
    cov, syy = F.col("xy") - mean * F.col("y"), F.col("yy") - F.col("y") * F.col("y") / n
    r2 = F.when((total > 0) & (syy > 0), F.least(cov * cov / (total * syy), F.lit(1.0)))
    infinite = F.lit(float("inf"))  # a feature fixed by the label; ranks first
    anova = F.when(
        (F.col("ssw") > 0) & (F.col("classes") > 1), F.try_divide(F.col("ssb") * (n - F.col("classes")), F.col("ssw") * (F.col("classes") - 1))
    ).when((F.col("ssb") > 0) & (F.col("classes") > 1), infinite)
    return g.select(
        "outer_fold", "feature", "pos", "is_indicator", "median", (~F.col("is_indicator") & (F.col("gaps") > 0)).alias("has_missing"), "rows", "mean",
        (total / n).alias("variance"), F.sqrt(total / n).alias("sd"), "qmin", "qmax", (F.col("qmax") > F.col("qmin")).alias("kept"),
        anova.alias("anova_f"), F.when(r2 >= 1, infinite).otherwise(F.try_divide(r2, 1 - r2) * (n - 2)).alias("corr_f"),
    )


def select(state: DataFrame, score: str, k: int | str) -> DataFrame:
    """Kept features per fold in rank order, the first min(k, available)."""
    alive = state.where("kept").withColumn("_s", F.round(score, 9))
    return tables.select_top_k(alive, ["outer_fold"], "_s", "pos", [k]).drop("_s", "requested")


def transform(rows: DataFrame, state: DataFrame, fold: str) -> DataFrame:
    """Impute, standardise and add indicators with the state of the row's ``fold`` column."""
    s = state.where("kept")
    plain = s.where(~F.col("is_indicator")).select(F.col("outer_fold").alias(fold), "feature", "median", "mean", "sd", "qmin", "qmax")
    marks = s.where("is_indicator").select(
        F.col("outer_fold").alias(fold), F.expr(f"substring(feature, {len(INDICATOR) + 1})").alias("feature"), "mean", "sd"
    )
    a = rows.join(plain, [fold, "feature"]).withColumn("imputed", F.coalesce("value", "median"))
    a = a.withColumn("scaled", (F.col("imputed") - F.col("mean")) / F.col("sd")).select(*rows.columns, "imputed", "scaled")
    b = rows.join(marks, [fold, "feature"]).withColumn("imputed", F.col("value").isNull().cast("double"))
    b = b.withColumn("scaled", (F.col("imputed") - F.col("mean")) / F.col("sd")).withColumn("feature", F.concat(F.lit(INDICATOR), "feature"))
    return a.unionByName(b.select(*rows.columns, "imputed", "scaled"))


def quantize_level(x: Column, lo: Column, hi: Column, levels: int) -> Column:
    """Equal-width level 0..levels-1, clipped; a zero span gives level 0."""
    span = hi - lo
    raw = F.floor((x - lo) / F.when(span > 0, span).otherwise(1.0) * levels)
    return F.when(span > 0, F.greatest(F.lit(0), F.least(F.lit(levels - 1), raw))).otherwise(0).cast("int")


def quantize(rows: DataFrame, state: DataFrame, fold: str, levels: int) -> DataFrame:
    s = state.where("not is_indicator").select(F.col("outer_fold").alias(fold), "feature", "median", "qmin", "qmax")
    j = rows.join(s, [fold, "feature"])
    level = quantize_level(F.coalesce("value", "median"), F.col("qmin"), F.col("qmax"), levels)
    return j.withColumn("level", level).select(*rows.columns, "level")


def zscore_split(df: DataFrame, split: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """Each split by its own mean and population spread."""
    g = df.groupBy(*split).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    j = ordered.key_join(df, g, split)
    return j.withColumn(out, F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mu")) / F.col("_sd"))).drop("_mu", "_sd")
