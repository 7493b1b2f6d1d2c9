"""The whole study in one plan: leakage-safe preparation, class prototypes, out-of-fold metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.numeric import argmax_low
from cohortloom.operators import metrics, prep

from .metric_queries import class_sql, rounded_metrics
from .preparation import PREP, folded
from .registry import query

TOP = 20

_STUDY = f"""{PREP}, chosen AS (SELECT outer_fold, feature FROM state WHERE kept QUALIFY row_number() OVER (PARTITION BY outer_fold ORDER BY round(anova_f, 9) DESC NULLS LAST, pos DESC) <= {TOP}),
every AS (SELECT o AS outer_fold, f.* FROM folded f, (SELECT unnest([1, 2, 3, 4, 5]) AS o)),
scaled AS (SELECT e.outer_fold, e.fold, vec_id, target_class, s.feature, CASE WHEN s.is_indicator THEN (CAST(value IS NULL AS DOUBLE) - mean) / sd ELSE (coalesce(value, median) - mean) / sd END AS x
  FROM every e JOIN state s ON e.outer_fold = s.outer_fold AND s.feature IN (e.feature, 'missingindicator_' || e.feature) JOIN chosen c ON c.outer_fold = s.outer_fold AND c.feature = s.feature WHERE s.kept),
proto AS (SELECT outer_fold, feature, target_class AS label, avg(x) AS p FROM scaled WHERE fold <> outer_fold GROUP BY ALL),
norms AS (SELECT outer_fold, label, sqrt(sum(p * p)) AS nrm FROM proto GROUP BY ALL),
sc AS (SELECT s.outer_fold, s.vec_id, any_value(s.target_class) AS y_true, p.label, round(sum(x * p) / any_value(nrm), 9) AS s FROM scaled s
  JOIN proto p ON s.outer_fold = p.outer_fold AND s.feature = p.feature JOIN norms n ON n.outer_fold = p.outer_fold AND n.label = p.label WHERE s.fold = s.outer_fold GROUP BY s.outer_fold, s.vec_id, p.label),
study AS (SELECT CAST(outer_fold AS BIGINT) AS outer_fold, vec_id, any_value(y_true) AS y_true, first(label ORDER BY s DESC, label) AS y_pred FROM sc GROUP BY outer_fold, vec_id)"""


def predictions(spark, sf):
    """One out-of-fold class per row from the nearest class mean over the selected, scaled features."""
    long = folded(spark, sf)
    state = prep.fit(long, "fold", 5, "target_class", "target_score")
    chosen = prep.select(state, "anova_f", TOP).select("outer_fold", "feature")

    def prepared(rows):
        return prep.transform(rows, state, "outer_fold").join(chosen, ["outer_fold", "feature"], "left_semi")

    classes = range(4)
    train = prepared(prep.train_copies(long, "fold", 5))
    proto = train.groupBy("outer_fold", "feature").agg(*[F.avg(F.when(F.col("target_class") == c, F.col("scaled"))).alias(f"p{c}") for c in classes])
    norms = proto.groupBy("outer_fold").agg(*[F.sqrt(F.sum(F.col(f"p{c}") * F.col(f"p{c}"))).alias(f"n{c}") for c in classes])
    held = prepared(long.withColumn("outer_fold", F.col("fold")))
    dots = held.join(proto, ["outer_fold", "feature"]).groupBy("outer_fold", "vec_id", F.col("target_class").alias("y_true")).agg(
        *[F.sum(F.col("scaled") * F.col(f"p{c}")).alias(f"d{c}") for c in classes]
    )
    scores = F.array(*[F.round(F.col(f"d{c}") / F.col(f"n{c}"), 9) for c in classes])
    return dots.join(norms, "outer_fold").select("outer_fold", "vec_id", "y_true", argmax_low(scores).alias("y_pred"))


@query("study_predictions", f"WITH {_STUDY} SELECT outer_fold, vec_id, y_true, y_pred FROM study")
def study_predictions(spark, sf):
    return predictions(spark, sf)


@query("study_metrics", f"WITH {_STUDY} {class_sql('study', 'outer_fold')}")
def study_metrics(spark, sf):
    return rounded_metrics(metrics.classification_metrics(predictions(spark, sf), ["outer_fold"]), ["outer_fold"])
