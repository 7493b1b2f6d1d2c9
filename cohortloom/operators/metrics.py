"""Metrics over prediction rows. One grouped pass of sums gives every classification figure."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.numeric import argmax_low, margin, rounded_class

from . import ordered

LABELS = (0, 1, 2, 3)
TOLERANCE = 1e-12


def _flag(c: Column) -> Column:
    return F.sum(c.cast("long"))


def class_sums(truth: str = "y_true", pred: str = "y_pred", labels: Sequence[int] = LABELS, weight: str | None = None) -> list[Column]:
    """Additive sufficient statistics of a set of class predictions (``weight`` repeats a row)."""
    t, p = F.col(truth), F.col(pred)
    w = F.col(weight) if weight else F.lit(1)
    step = F.abs(t - p)

    def total(c: Column) -> Column:
        return F.sum(F.when(c, w).otherwise(0))

    per_class = [
        c for k in labels
        for c in (total((t == k) & (p == k)).alias(f"_tp{k}"), total(t == k).alias(f"_sup{k}"), total(p == k).alias(f"_pos{k}"))
    ]
    return [
        F.sum(w).alias("_n"), total(t == p).alias("_hit"), total(step >= 2).alias("_severe"), total(step <= 1).alias("_near"),
        total(step == max(labels) - min(labels)).alias("_extreme"), F.sum(w * (t - p) * (t - p)).alias("_d2"),
        F.sum(w * t).alias("_t"), F.sum(w * p).alias("_p"), F.sum(w * t * t).alias("_t2"), F.sum(w * p * p).alias("_p2"), *per_class,
    ]


def class_scores(labels: Sequence[int] = LABELS) -> list[Column]:
    """Metric columns from ``class_sums``. A class nobody holds or predicts scores 0 in the fixed
    macro mean and is left out of the ``_observed`` one."""
    n = F.col("_n")
    tp, sup, pos = ({k: F.col(f"_{s}{k}") for k in labels} for s in ("tp", "sup", "pos"))
    f1 = {k: F.when(sup[k] + pos[k] > 0, 2 * tp[k] / (sup[k] + pos[k])).otherwise(0.0) for k in labels}
    recall = {k: F.when(sup[k] > 0, tp[k] / sup[k]).otherwise(0.0) for k in labels}
    precision = {k: F.when(pos[k] > 0, tp[k] / pos[k]).otherwise(0.0) for k in labels}

    def add(cols) -> Column:
        cols = list(cols)
        out = cols[0]
        for c in cols[1:]:
            out = out + c
        return out

    seen = add(F.when(sup[k] + pos[k] > 0, 1).otherwise(0) for k in labels)
    held = add(F.when(sup[k] > 0, 1).otherwise(0) for k in labels)
    expected = F.col("_t2") + F.col("_p2") - 2.0 * F.col("_t") * F.col("_p") / n
    return [
        n.alias("rows"), (add(f1.values()) / len(labels)).alias("macro_f1"), F.try_divide(add(f1.values()), seen).alias("macro_f1_observed"),
        (add(f1[k] * sup[k] for k in labels) / n).alias("weighted_f1"), F.try_divide(add(recall.values()), held).alias("balanced_accuracy"),
        (F.col("_hit") / n).alias("accuracy"), (F.col("_severe") / n).alias("severe_error_rate"),
        (F.col("_near") / n).alias("adjacent_accuracy"), F.col("_extreme").alias("extreme_confusions"),
        F.when(expected > 0, 1 - F.col("_d2") / expected).alias("quadratic_weighted_kappa"),
        *[recall[k].alias(f"recall_{k}") for k in labels], *[precision[k].alias(f"precision_{k}") for k in labels],
    ]


def classification_metrics(pred: DataFrame, keys: Sequence[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    return pred.groupBy(*keys).agg(*class_sums(truth, guess)).select(*keys, *class_scores())


def confusion(pred: DataFrame, keys: Sequence[str], truth: str = "y_true", guess: str = "y_pred", labels: Sequence[int] = LABELS) -> DataFrame:
    """The full label x label matrix as JSON text, rows = truth."""
    cells = F.array(*[
        F.array(*[_flag((F.col(truth) == t) & (F.col(guess) == p)) for p in labels]) for t in labels
    ])
    return pred.groupBy(*keys).agg(F.to_json(cells).alias("confusion_matrix"))


def regression_sums(truth: str = "target_score", raw: str = "y_pred_raw", bounded: str = "y_pred_bounded") -> list[Column]:
    y, x, b = F.col(truth), F.col(raw), F.col(bounded)
    clipped = F.abs(x - b) > TOLERANCE
    return [
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(y - x)).alias("raw_mae"), F.avg(F.abs(y - b)).alias("bounded_mae"),
        F.sqrt(F.avg((y - b) * (y - b))).alias("bounded_rmse"),
        F.when(F.var_pop(y) > 0, 1 - F.avg((y - b) * (y - b)) / F.var_pop(y)).alias("bounded_r2"),
        _flag(clipped).alias("clip_count"), F.avg(clipped.cast("double")).alias("clip_rate"),
        F.avg((F.abs(rounded_class(y) - rounded_class(b)) >= 2).cast("double")).alias("severe_error_rate"),
    ]


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, rows_per_chunk: int | None = None) -> DataFrame:
    """Rank correlation with averaged ties, NULL when a side is constant.

    Rows are first folded into distinct (x, y) pairs with a count, so a value shared by most
    rows costs one row per distinct partner and no row is ever ranked on its own.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(
        F.count(F.lit(1)).alias("_c")
    )

    def ranks(col: str, name: str) -> DataFrame:
        counts = pairs.groupBy(*keys, col).agg(F.sum("_c").alias("_count"))
        below = ordered.running(counts, keys, [col], {"_below": ("sum", "_count")}, inclusive=False, rows_per_chunk=rows_per_chunk)
        return below.select(*keys, col, (F.col("_below") + (F.col("_count") + 1) / 2).alias(name))

    j = pairs.join(ranks("_x", "_rx"), [*keys, "_x"]).join(ranks("_y", "_ry"), [*keys, "_y"])
    c, rx, ry = F.col("_c"), F.col("_rx"), F.col("_ry")
    g = j.groupBy(*keys).agg(
        F.sum(c).cast("double").alias("_n"), F.sum(c * rx * ry).alias("_xy"), F.sum(c * rx * rx).alias("_xx"), F.sum(c * ry * ry).alias("_yy")
    )
    n = F.col("_n")
    base = n * (n + 1) * (n + 1) / 4
    sx, sy = F.col("_xx") - base, F.col("_yy") - base
    return g.select(*keys, F.when((sx > 0) & (sy > 0), (F.col("_xy") - base) / F.sqrt(sx * sy)).alias("spearman"))


def regression_metrics(pred: DataFrame, keys: Sequence[str], truth: str = "target_score", raw: str = "y_pred_raw", bounded: str = "y_pred_bounded") -> DataFrame:
    plain = pred.groupBy(*keys).agg(*regression_sums(truth, raw, bounded))
    return ordered.key_join(plain, spearman(pred, keys, truth, bounded), keys, "left")


def regression_diagnostics(pred: DataFrame, keys: Sequence[str], truth: str = "target_score", guess: str = "y_pred_bounded") -> DataFrame:
    y, b = F.col(truth), F.col(guess)
    level = rounded_class(b)
    per_level = []
    for k in range(1, 5):
        at = y == float(k)
        per_level += [
            F.count(F.when(at, 1)).alias(f"level_{k}_rows"), F.avg(F.when(at, F.abs(y - b))).alias(f"level_{k}_mae"),
            F.avg(F.when(at, b)).alias(f"level_{k}_mean"), F.stddev_pop(F.when(at, b)).alias(f"level_{k}_std"),
        ]
    distinct = [F.max((level == k).cast("long")) for k in LABELS]
    return pred.groupBy(*keys).agg(
        F.avg(b).alias("prediction_mean"), F.stddev_pop(b).alias("prediction_std"), (F.max(b) - F.min(b)).alias("prediction_range"),
        F.avg(F.abs(b - 2.5)).alias("midpoint_distance"), (distinct[0] + distinct[1] + distinct[2] + distinct[3]).alias("rounded_levels"),
        F.avg((F.abs(y - b) <= 1).cast("double")).alias("adjacent_accuracy"), F.avg((F.abs(y - b) >= 2).cast("double")).alias("severe_error_rate"),
        F.when(F.stddev_samp(y) > 0, F.stddev_samp(b) / F.stddev_samp(y)).alias("mean_collapse_ratio"), *per_level,
    )


def head_agreement(pred: DataFrame, keys: Sequence[str], cls: str = "y_pred", score: str = "y_pred_bounded") -> DataFrame:
    """How far the class head and the score head agree."""
    s = F.col(score)
    return pred.groupBy(*keys).agg(
        F.avg((F.col(cls) == rounded_class(s)).cast("double")).alias("agreement_rate"),
        F.avg(F.abs(F.col(cls) + 1 - s)).alias("mean_abs_difference"), F.avg(F.abs(s - F.rint(s))).alias("integer_distance"),
    )


#: Seeds that share one bit mask.
SEEDS_A_MASK = 60


def canonicalize(pred: DataFrame, keys: Sequence[str], seeds: Sequence[int], keep: Sequence[str] = (), labels: Sequence[int] = LABELS) -> DataFrame:
    """One row per key from seed-level rows: mean scores then argmax, mean raw score then clip.

    Fails when a key does not hold exactly the given seeds once each.
    """
    means = [F.round(F.avg(F.get("scores", F.lit(k))), 9).alias(f"_s{k}") for k in labels]
    place = F.array_position(F.array(*[F.lit(s) for s in seeds]), F.col("seed")).cast("int")
    # which seeds a key holds, as bits of as many long numbers as they need
    cuts = range(0, len(seeds), SEEDS_A_MASK)
    one = F.lit(1).cast("long")
    masks = [
        F.bit_or(F.when((place > c) & (place <= c + SEEDS_A_MASK), F.call_function("shiftleft", one, place - 1 - c))).alias(f"_seeds{c}") for c in cuts
    ]
    g = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *masks, *[F.first(c).alias(c) for c in keep], *means, F.round(F.avg("y_pred_raw"), 9).alias("_raw")
    )
    exact = F.col("_n") == len(seeds)
    for c in cuts:
        exact = exact & F.coalesce(F.col(f"_seeds{c}") == (1 << min(SEEDS_A_MASK, len(seeds) - c)) - 1, F.lit(False))
    g = g.where(F.when(exact, F.lit(True)).otherwise(F.raise_error(F.lit("a run does not hold exactly the expected seeds")).cast("boolean")))
    raw = F.col("_raw")
    scores = F.array(*[F.col(f"_s{k}") for k in labels])
    return g.select(
        *keys, *keep, scores.alias("scores"), argmax_low(scores).alias("y_pred"), F.array_max(scores).alias("confidence"),
        margin(scores).alias("margin"), raw.alias("y_pred_raw"), F.greatest(F.lit(1.0), F.least(F.lit(4.0), raw)).alias("y_pred_bounded"),
    )


def seed_stability(metrics: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Spread of one metric over its seeds (a handful of rows per key)."""
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"),
    )


def metrics_rollup(pred: DataFrame, dims: Sequence[str], grains: Sequence[Sequence[str]], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """The same metrics at several grains in one pass; a dimension outside the grain reads 'ALL'."""
    cols = [F.col(d) for d in dims]
    g = pred.groupingSets([[F.col(c) for c in grain] for grain in grains], *cols).agg(
        *class_sums(truth, guess), *[F.grouping(d).alias(f"_all_{d}") for d in dims]
    )
    named = [F.when(F.col(f"_all_{d}") == 1, "ALL").otherwise(F.col(d).cast("string")).alias(d) for d in dims]
    return g.select(*named, *class_scores())


def subject_stability(values: DataFrame, keys: Sequence[str], unit: str, value: str, higher_is_better: bool = True) -> DataFrame:
    q = ordered.exact_quantiles(values, keys, value, [0.25, 0.5, 0.75], "_q")
    sign = F.col(value) if higher_is_better else -F.col(value)
    g = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("subjects"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.min_by(unit, F.struct(-sign, unit)).alias("best_subject"), F.min_by(unit, F.struct(sign, unit)).alias("worst_subject"),
    )
    j = ordered.key_join(g, q, keys)
    q1, q2, q3 = (F.get("_q", F.lit(i)) for i in range(3))
    return j.select(
        *keys, "subjects", "mean", "sd", q2.alias("median"), q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"), "min", "max",
        F.when(F.abs("mean") > 1e-8, F.col("sd") / F.abs("mean")).alias("cv"), "best_subject", "worst_subject",
    )


def flag_top_quartile(df: DataFrame, keys: Sequence[str], value: str, out: str = "unstable") -> DataFrame:
    q = ordered.exact_quantiles(df, keys, value, [0.75], "_q")
    return ordered.key_join(df, q, keys, "left").withColumn(out, F.col(value) >= F.get("_q", F.lit(0))).drop("_q")


def corr_report(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    plain = df.groupBy(*keys).agg(F.corr(actual, predicted).alias("pearson"), F.avg((a - p) * (a - p)).alias("mse"), F.count(F.lit(1)).alias("rows"))
    return ordered.key_join(plain, spearman(df, keys, actual, predicted), keys, "left")


def roc_points(df: DataFrame, score: str, positive: Column, rows_per_chunk: int | None = None) -> DataFrame:
    """One point per distinct score, from the highest down: running true and false positive rates."""
    per = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(positive.cast("long")).alias("_pos"), F.sum((~positive).cast("long")).alias("_neg")
    ).withColumn("_down", -F.col("threshold"))
    run = ordered.running(per, [], ["_down"], {"_tp": ("sum", "_pos"), "_fp": ("sum", "_neg")}, rows_per_chunk=rows_per_chunk)
    p = per.agg(F.sum("_pos")).scalar()
    n = per.agg(F.sum("_neg")).scalar()
    return run.select("threshold", *[F.try_divide(c, total).alias(a) for c, total, a in (
        (F.col("_tp"), p, "tpr"), (F.col("_fp"), n, "fpr"), (F.col("_pos"), p, "_dy"), (F.col("_neg"), n, "_dx")
    )])


def roc_auc(points: DataFrame) -> DataFrame:
    """Trapezoid area: each point adds its false-positive step times the mid height."""
    return points.agg(F.sum(F.col("_dx") * (F.col("tpr") - F.col("_dy") / 2)).alias("auc"), F.count(F.lit(1)).alias("points"))


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Best row per group by a priority chain of (column, ascending); numeric columns only when descending."""
    rank = F.struct(*[F.col(c) if asc else -F.col(c) for c, asc in order])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_best")).select(*keys, "_best.*")
