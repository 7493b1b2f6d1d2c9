"""Subject-level statistics: rank tests, effect sizes, bootstrap intervals, comparison tables."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.special import chi2_sf, wilcoxon_p

from . import joins, metrics, ordered

ZERO = 1e-12
MAX_HELD = 20_000_000  # numbers a task keeps before it hands partial sums on


def signed_ranks(df: DataFrame, keys: Sequence[str], diff: str, rows_per_chunk: int | None = None) -> DataFrame:
    """W+, W-, n and the tie term of the non-zero differences per key.

    Differences are folded into distinct sizes with signed counts; the rank of a size follows from
    the running count, so no row-level ranking takes place.
    """
    d = F.col(diff)
    sized = df.where(d.isNotNull()).groupBy(*keys, F.abs(d).alias("_size")).agg(
        F.count(F.when(d > ZERO, 1)).alias("_pos"), F.count(F.when(d < -ZERO, 1)).alias("_neg"), F.count(F.lit(1)).alias("_all")
    ).withColumn("_count", F.col("_pos") + F.col("_neg"))
    below = ordered.running(sized, keys, ["_size"], {"_below": ("sum", "_count")}, inclusive=False, rows_per_chunk=rows_per_chunk)
    rank, c = F.col("_below") + (F.col("_count") + 1) / 2.0, F.col("_count")
    return below.groupBy(*keys).agg(
        F.sum(F.col("_pos") * rank).alias("w_plus"), F.sum(F.col("_neg") * rank).alias("w_minus"), F.sum(c).alias("n"),
        F.sum(c.cast("double") * c * c - c).alias("tie_term"), (F.sum("_all") - F.sum(c)).alias("zeros"),
    )


def wilcoxon(df: DataFrame, keys: Sequence[str], diff: str) -> DataFrame:
    """Signed-rank test (zeros dropped, two-sided) with the rank-biserial effect size."""
    s = signed_ranks(df, keys, diff)
    w = F.least("w_plus", "w_minus")
    rough = ((F.col("tie_term") > 0) | (F.col("zeros") > 0)).cast("double")
    p = wilcoxon_p(w, F.col("n").cast("double"), F.col("tie_term"), rough)
    return s.select(*keys, "n", w.alias("statistic"), p.alias("p_value"), rank_biserial(None).alias("effect"))


def rank_biserial(when_all_zero: float | None = None) -> Column:
    """(W+ - W-) / (W+ + W-) over ``signed_ranks`` columns."""
    total = F.col("w_plus") + F.col("w_minus")
    return F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / total).otherwise(F.lit(when_all_zero).cast("double"))


def friedman(df: DataFrame, keys: Sequence[str], unit: str, condition: str, value: str, conditions: Sequence[str]) -> DataFrame:
    """Chi-square over k conditions; ranks are formed inside each unit's k values, units with a gap are left out."""
    k = len(conditions)
    cells = [F.max(F.when(F.col(condition) == c, F.col(value))) for c in conditions]
    wide = df.groupBy(*keys, unit).agg(F.array(*cells).alias("_v")).where(~F.exists("_v", lambda x: x.isNull()))

    def peers(x: Column) -> Column:
        return F.size(F.filter("_v", lambda y: y == x))

    ranks = F.transform("_v", lambda x: F.size(F.filter("_v", lambda y: y < x)) + (peers(x) + 1) / 2.0)
    ties = F.aggregate(F.transform("_v", lambda x: peers(x) * peers(x) - 1), F.lit(0), lambda a, x: a + x)
    g = wide.select(*keys, ranks.alias("_r"), ties.alias("_ties")).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_ties").alias("_ties"), *[F.sum(F.get("_r", F.lit(i))).alias(f"_s{i}") for i in range(k)]
    )
    n = F.col("_n")
    squares = F.lit(0.0)
    for i in range(k):
        squares = squares + F.col(f"_s{i}") * F.col(f"_s{i}")
    correction = 1 - F.col("_ties") / (n * k * (k * k - 1))
    chi2 = F.when(correction > 0, (12 / (n * k * (k + 1)) * squares - 3 * n * (k + 1)) / correction)
    out = g.select(*keys, n.cast("long").alias("subjects"), chi2.alias("statistic"))
    return out.withColumn("status", F.when(F.col("statistic").isNull(), "NOT_ESTIMABLE").otherwise("PASS"))


def friedman_p(test: DataFrame, k: int) -> DataFrame:
    return test.withColumn("p_value", chi2_sf("statistic", F.lit(float(k - 1))))


def holm(df: DataFrame, family: Sequence[str], p: str, tie: str) -> DataFrame:
    """Step-down adjustment inside each family of hypotheses."""
    w = Window.partitionBy(*family).orderBy(p, tie)
    m = F.count(p).over(Window.partitionBy(*family))
    step = F.when(F.col(p).isNotNull(), F.col(p) * (m - F.row_number().over(Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), tie)) + 1))
    stepped = df.withColumn("_step", step)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_step").over(upto)))).drop("_step")


def _draw(salt: str, rep: Column, position: Column, n: Column) -> Column:
    text = F.concat_ws("|", F.lit(salt), rep.cast("string"), position.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def number_units(units: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Units with their 0-based position ``_i`` in the key and the key's size ``_n``."""
    numbered = ordered.row_numbers(units, keys, [unit], "_i").withColumn("_i", F.col("_i") - 1)
    if not keys:
        return numbered.withColumn("_n", units.agg(F.count(F.lit(1))).scalar())
    return ordered.key_join(numbered, units.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)


def draws_of(numbered: DataFrame, keys: Sequence[str], reps: int, salt: str) -> DataFrame:
    """The replicates that draw position ``_i`` (one entry per draw), for every key size ``_n``.

    A draw is a digest of (salt, replicate, draw number) modulo the size, so keys of equal size
    share one set of draws and a lost task redraws the same sample. The unit rows are spread out
    first because each one makes ``reps`` draws.
    """
    first = F.struct(*keys) if keys else F.lit(0)
    marked = numbered.select(first.alias("_k"), "_i", "_n")
    one = marked.groupBy("_n").agg(F.min("_k").alias("_k"))
    spread = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    positions = marked.join(one, ["_n", "_k"]).select("_n", "_i").repartition(spread, "_n", "_i")
    draws = positions.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    picks = draws.select("_n", "_rep", _draw(salt, F.col("_rep"), F.col("_i"), F.col("_n")).alias("_i"))
    return picks.groupBy("_n", "_i").agg(F.collect_list("_rep").alias("_reps"))


def resampled_sums(units: DataFrame, keys: Sequence[str], columns: Sequence[str], reps: int) -> DataFrame:
    """Per (keys, replicate): the columns summed over the drawn units.

    A batch of units adds (draw counts) x (columns) as one matrix product, so a task emits one row
    per key and replicate and no unit row is copied.
    """
    keys, columns = list(keys), list(columns)
    types = {f.name: f.dataType for f in units.schema.fields}
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys] + [T.StructField("_rep", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in columns]
    )

    def add_up(batches):
        sums: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(keys, dropna=False) if keys else [((), pdf)]:
                counts = np.stack([np.bincount(r, minlength=reps + 1)[1:] for r in g["_reps"]])
                part = counts.T @ g[columns].to_numpy(dtype=float)
                sums[key] = sums[key] + part if key in sums else part
            if len(sums) * reps * len(columns) > MAX_HELD:
                yield from rows(sums)
                sums = {}
        yield from rows(sums)

    def rows(sums):
        for key, total in sums.items():
            out = pd.DataFrame(total, columns=columns)
            out.insert(0, "_rep", np.arange(1, reps + 1, dtype="int32"))
            for k, v in reversed(list(zip(keys, key))):
                out.insert(0, k, v)
            yield out

    partial = units.select(*keys, "_reps", *columns).mapInPandas(add_up, schema)
    return partial.groupBy(*keys, "_rep").agg(*[F.sum(c).alias(c) for c in columns])


def bootstrap_ci(df: DataFrame, keys: Sequence[str], unit: str, value: str, reps: int = 2000, salt: str = "boot", level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over units."""
    df = ordered.settle(df)  # one row per unit, read for the numbers, the draws and the point estimate
    numbered = ordered.settle(number_units(df.where(F.col(value).isNotNull()), keys, unit))
    # A position nobody draws adds nothing and drops out of the join. Draws are many for each unit, so they never pass the driver.
    drawn = numbered.withColumn("_one", F.lit(1.0)).join(draws_of(numbered, keys, reps, salt).hint("merge"), ["_n", "_i"])
    sums = resampled_sums(drawn, keys, [value, "_one"], reps)
    means = ordered.settle(sums.select(*keys, (F.col(value) / F.col("_one")).alias("_estimate")))
    tail = (1 - level) / 2
    q = ordered.exact_quantiles(means, keys, "_estimate", [tail, 1 - tail], "_q")
    point = df.groupBy(*keys).agg(F.avg(value).alias("estimate"), F.count(value).alias("units"))
    j = ordered.key_join(point, q, keys)
    return j.select(*keys, "units", "estimate", F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("ci_high"))


def cluster_bootstrap(pred: DataFrame, keys: Sequence[str], unit: str, metric: str, reps: int = 2000, salt: str = "cluster") -> DataFrame:
    """Percentile interval of a pooled classification metric, resampling whole units.

    Each unit is first reduced to its additive sums; a replicate adds up the sums of its drawn units,
    so prediction rows are read once whatever the number of replicates. The same draws serve every key.
    """
    sums = ordered.settle(pred.groupBy(*keys, unit).agg(*metrics.class_sums()))
    parts = [c for c in sums.columns if c not in (*keys, unit)]
    numbered = ordered.settle(number_units(sums.select(unit).distinct(), [], unit))
    of_unit = numbered.join(draws_of(numbered, [], reps, salt).hint("merge"), ["_n", "_i"]).select(unit, "_reps")
    drawn = sums.join(of_unit.hint("merge"), unit)  # draws are many for each unit, so they never pass the driver
    scores = ordered.settle(resampled_sums(drawn, keys, parts, reps).select(*keys, "_rep", *metrics.class_scores()))
    q = ordered.exact_quantiles(scores, keys, metric, [0.025, 0.975], "_q")
    point = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts]).select(*keys, *metrics.class_scores())
    j = ordered.key_join(point.select(*keys, F.col(metric).alias("estimate")), q, keys)
    return j.select(*keys, "estimate", F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("ci_high"))


def degradation(df: DataFrame, unit: Sequence[str], condition: str, reference: str, value: str, conditions: Sequence[str], higher_is_better: Column | bool = True) -> DataFrame:
    """Per (unit, condition): how much worse than the reference condition; positive is always worse."""
    ref = F.max(F.when(F.col(condition) == reference, F.col(value)))
    cells = F.array(*[F.struct(F.lit(c).alias(condition), F.max(F.when(F.col(condition) == c, F.col(value))).alias("condition_value")) for c in conditions])
    g = df.groupBy(*unit).agg(ref.alias("reference_value"), cells.alias("_c")).where(F.col("reference_value").isNotNull())
    long = g.select(*unit, "reference_value", F.explode("_c").alias("_c")).select(*unit, "reference_value", "_c.*").where(F.col("condition_value").isNotNull())
    loss = F.col("reference_value") - F.col("condition_value")
    up = F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better
    return long.withColumn("degradation", F.when(up, loss).otherwise(-loss))


def degradation_summary(deg: DataFrame, keys: Sequence[str]) -> DataFrame:
    med = ordered.exact_quantiles(deg, keys, "degradation", [0.5], "_q")
    g = deg.groupBy(*keys).agg(F.count(F.lit(1)).alias("subjects"), F.avg("degradation").alias("mean_degradation"), F.avg("reference_value").alias("_ref"))
    j = ordered.key_join(g, med, keys)
    return j.select(
        *keys, "subjects", "mean_degradation", F.get("_q", F.lit(0)).alias("median_degradation"),
        F.when(F.abs("_ref") > 1e-8, F.col("mean_degradation") / F.abs("_ref") * 100).alias("relative_percent"),
        F.when(F.col("mean_degradation") > 0, "DECREASE").otherwise("IMPROVEMENT_OR_NO_DECREASE").alias("direction"),
    )


def rank_conditions(df: DataFrame, keys: Sequence[str], condition: str, value: str, reference: str, higher_is_better: bool = True) -> DataFrame:
    """Shared rank of conditions per key with the distance to the reference condition."""
    from .tables import shared_rank

    ref = df.where(F.col(condition) == reference).select(*keys, F.col(value).alias("_ref"))
    ranked = shared_rank(df.where(F.col(condition) != reference), keys, [(value, not higher_is_better)], condition)
    return ordered.key_join(ranked, ref, keys, "left").withColumn("delta_to_reference", F.col(value) - F.col("_ref")).drop("_ref")


def contrast(df: DataFrame, keys: Sequence[str], unit: str, model: str, value: str, a: str, b: str) -> DataFrame:
    """Descriptive two-model contrast over paired units."""
    pair = joins.paired(df, [*keys, unit], model, a, b, value)
    return pair.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("subjects"), F.avg("left_value").alias("left_mean"), F.avg("right_value").alias("right_mean"),
        F.avg(F.col("left_value") - F.col("right_value")).alias("mean_difference"),
        F.when(F.avg("left_value") < F.avg("right_value"), a).otherwise(b).alias("lower"),
    )


def comparison_table(df: DataFrame, keys: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """mean ± sample SD as text, with the number of repeats."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeats"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return g.select(*keys, "repeats", F.format_string(f"%.{digits}f ± %.{digits}f", F.round("_m", digits), F.round("_s", digits)).alias("summary"))
