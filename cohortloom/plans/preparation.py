"""Folds and fold-local preprocessing."""
from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortloom.operators import folds, prep

from .inputs import FEATURES, SAMPLES, features, r, samples, vectors
from .registry import query

LABELS = [0, 1, 2, 3]

GREEDY = """g AS (SELECT subject, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, subject) AS rn FROM samples GROUP BY subject),
walk(rn, subject, n, fold, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 0, [0::BIGINT, 0, 0, 0, 0]
  UNION ALL
  SELECT g.rn, g.subject, g.n, list_position(loads, list_min(loads)),
    list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END)
  FROM walk JOIN g ON g.rn = walk.rn + 1)"""


@query("q13_group_kfold", f"WITH RECURSIVE {SAMPLES}, {GREEDY} SELECT subject, n AS group_rows, CAST(fold AS INTEGER) AS fold FROM walk WHERE rn > 0")
def q13(spark, sf):
    return folds.group_kfold(samples(spark, sf), "subject", 5)


@query("q13_snake_folds", f"""
WITH {SAMPLES}, g AS (SELECT subject, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, subject) - 1) % 10 AS spot FROM samples GROUP BY subject)
SELECT subject, n AS group_rows, CAST(CASE WHEN spot < 5 THEN spot + 1 ELSE 10 - spot END AS INTEGER) AS fold FROM g""")
def q13_snake(spark, sf):
    return folds.snake_folds(samples(spark, sf), "subject", 5)


@query("q14_nested_folds", f"""
WITH RECURSIVE {SAMPLES}, s AS (SELECT subject, subject % 5 + 1 AS own FROM samples),
g AS (SELECT o AS outer_fold, subject, count(*) AS n, row_number() OVER (PARTITION BY o ORDER BY count(*) DESC, subject) AS rn
  FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS o) WHERE own <> o GROUP BY o, subject),
walk(outer_fold, rn, subject, n, fold, loads) AS (
  SELECT unnest([1, 2, 3, 4, 5]), CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 0, [0::BIGINT, 0, 0]
  UNION ALL
  SELECT g.outer_fold, g.rn, g.subject, g.n, list_position(loads, list_min(loads)),
    list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END)
  FROM walk JOIN g ON g.rn = walk.rn + 1 AND g.outer_fold = walk.outer_fold)
SELECT outer_fold, subject, n AS group_rows, CAST(fold AS INTEGER) AS inner_fold FROM walk WHERE rn > 0""")
def q14(spark, sf):
    s = samples(spark, sf).withColumn("own", (F.col("subject") % 5 + 1).cast("int"))
    return folds.nested_folds(s, "subject", "own", 5, 3)


_LABELLED = "lab AS (SELECT subject, CAST(least(3, floor(value / 50)) AS INTEGER) AS y, subject % 5 + 1 AS fold FROM samples)"


def labelled(spark, sf):
    return samples(spark, sf).select(
        "subject", F.least(F.lit(3), F.floor(F.col("value") / 50)).cast("int").alias("y"), (F.col("subject") % 5 + 1).alias("fold")
    )


def _complement_sql(key: str) -> str:
    return f"""SELECT a.{key}, count(*) FILTER (WHERE b.{key} = a.{key}) AS test_rows, count(*) FILTER (WHERE b.{key} <> a.{key}) AS train_rows,
  count(DISTINCT b.y) FILTER (WHERE b.{key} = a.{key}) AS test_classes, count(DISTINCT b.y) FILTER (WHERE b.{key} <> a.{key}) AS train_classes
FROM (SELECT DISTINCT {key} FROM lab) a CROSS JOIN lab b GROUP BY a.{key}"""


@query("q15_leave_one_subject_out", f"WITH {SAMPLES}, {_LABELLED}, c AS ({_complement_sql('subject')}) SELECT *, 'LOSO_' || subject AS split_id FROM c")
def q15(spark, sf):
    return folds.leave_one_out(labelled(spark, sf), "subject", "y", LABELS)


@query("q16_split_audit", f"""
WITH {SAMPLES}, {_LABELLED}, c AS ({_complement_sql('fold')}),
p AS (SELECT a.fold, count(DISTINCT CASE WHEN b.fold = a.fold THEN b.subject END) AS test_groups, count(DISTINCT CASE WHEN b.fold <> a.fold THEN b.subject END) AS train_groups
  FROM (SELECT DISTINCT fold FROM lab) a CROSS JOIN lab b GROUP BY a.fold)
SELECT c.*, test_groups, train_groups, 0::BIGINT AS overlap_groups FROM c JOIN p ON c.fold = p.fold""")
def q16(spark, sf):
    return folds.split_audit(labelled(spark, sf), "fold", "subject", "y", LABELS)


@query("q17_run_matrix", f"""
WITH {SAMPLES}, c AS (SELECT DISTINCT stream AS condition FROM samples)
SELECT condition, fold, model, seed, condition || '|' || fold || '|' || model || '|' || seed AS run_id FROM c,
  (SELECT unnest([1, 2, 3, 4, 5]) AS fold), (SELECT unnest(['HDC', 'TRADITIONAL']) AS model), (SELECT unnest([42, 43, 44, 45, 46]) AS seed)""")
def q17(spark, sf):
    c = samples(spark, sf).select(F.col("stream").alias("condition")).distinct()
    return folds.run_matrix(c, {"fold": [1, 2, 3, 4, 5], "model": ["HDC", "TRADITIONAL"], "seed": [42, 43, 44, 45, 46]})


# --- preprocessing -----------------------------------------------------------------------------

FOLDED = FEATURES + """, folded AS (SELECT vec_id, subject, target_class, target_score, pos, feature, subject % 5 + 1 AS fold,
  CASE WHEN pos = 60 THEN NULL WHEN pos = 61 THEN 1.5::DOUBLE ELSE value END AS value FROM gappy)"""

PREP = FOLDED + """, train AS (SELECT o AS outer_fold, f.* FROM folded f, (SELECT unnest([1, 2, 3, 4, 5]) AS o) WHERE fold <> o),
med AS (SELECT outer_fold, feature, coalesce(quantile_cont(value, 0.5), 0) AS median, count(*) - count(value) AS gaps FROM train GROUP BY outer_fold, feature),
imp AS (
  SELECT t.outer_fold, t.feature, t.pos, false AS is_indicator, target_class, target_score, coalesce(value, median) AS x, median, gaps
  FROM train t JOIN med m ON t.outer_fold = m.outer_fold AND t.feature = m.feature
  UNION ALL
  SELECT t.outer_fold, 'missingindicator_' || t.feature, 64 + t.pos, true, target_class, target_score, CAST(value IS NULL AS DOUBLE), 0, 0
  FROM train t JOIN med m ON t.outer_fold = m.outer_fold AND t.feature = m.feature WHERE gaps > 0),
cls AS (SELECT outer_fold, feature, target_class, count(*) AS nc, avg(x) AS mc, var_pop(x) * count(*) AS wc FROM imp GROUP BY ALL),
tot AS (SELECT outer_fold, feature, any_value(pos) AS pos, any_value(is_indicator) AS is_indicator, any_value(median) AS median, any_value(gaps) AS gaps, count(*) AS rows, avg(x) AS mean,
  CASE WHEN min(x) = max(x) THEN 0 ELSE var_pop(x) END AS variance, min(x) AS qmin, max(x) AS qmax, corr(x, target_score) AS rho FROM imp GROUP BY outer_fold, feature),
anova AS (SELECT c.outer_fold, c.feature, sum(nc * (mc - mean) ** 2) AS ssb, sum(wc) AS ssw, count(*) AS classes FROM cls c JOIN tot t ON c.outer_fold = t.outer_fold AND c.feature = t.feature GROUP BY ALL),
state AS (SELECT t.*, sqrt(variance) AS sd, qmax > qmin AS kept, gaps > 0 AS has_missing,
  CASE WHEN qmax > qmin THEN (ssb / (classes - 1)) / (ssw / (rows - classes)) END AS anova_f, CASE WHEN qmax > qmin THEN rho * rho / (1 - rho * rho) * (rows - 2) END AS corr_f
  FROM tot t JOIN anova a ON t.outer_fold = a.outer_fold AND t.feature = a.feature)"""


def folded(spark, sf):
    f = features(spark, sf, missing=True)
    v = F.when(F.col("pos") == 60, F.lit(None).cast("double")).when(F.col("pos") == 61, F.lit(1.5)).otherwise(F.col("value"))
    return f.withColumn("value", v).withColumn("fold", F.col("subject") % 5 + 1)


def state(spark, sf):
    return prep.fit(folded(spark, sf), "fold", 5, "target_class", "target_score")


@query("x01_impute_and_indicate", f"WITH {PREP} SELECT outer_fold, feature, round(median, 8) + 0.0 AS median, has_missing, is_indicator FROM state")
def x01(spark, sf):
    s = state(spark, sf)
    return s.select("outer_fold", "feature", r("median").alias("median"), "has_missing", "is_indicator")


@query("x02_variance_filter", f"WITH {PREP} SELECT outer_fold, feature, round(variance, 8) + 0.0 AS variance, kept FROM state")
def x02(spark, sf):
    return state(spark, sf).select("outer_fold", "feature", r("variance").alias("variance"), "kept")


@query("x03_standardize", f"WITH {PREP} SELECT outer_fold, feature, round(mean, 8) + 0.0 AS mean, round(sd, 7) + 0.0 AS sd FROM state WHERE kept")
def x03(spark, sf):
    return state(spark, sf).where("kept").select("outer_fold", "feature", r("mean").alias("mean"), r("sd", 7).alias("sd"))


@query("x04_zscore_split", f"""
WITH {FEATURES} SELECT vec_id, feature, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) + 0.0 AS z FROM features WINDOW w AS (PARTITION BY subject % 5, feature)""")
def x04(spark, sf):
    f = features(spark, sf).withColumn("split", F.col("subject") % 5)
    return prep.zscore_split(f, ["split", "feature"], "value").select("vec_id", "feature", r("z", 6).alias("z"))


@query("x05_anova_f", f"WITH {PREP} SELECT outer_fold, feature, round(anova_f, 6) + 0.0 AS anova_f FROM state WHERE kept")
def x05(spark, sf):
    return state(spark, sf).where("kept").select("outer_fold", "feature", r("anova_f", 6).alias("anova_f"))


@query("x06_correlation_f", f"WITH {PREP} SELECT outer_fold, feature, round(corr_f, 6) + 0.0 AS corr_f FROM state WHERE kept")
def x06(spark, sf):
    return state(spark, sf).where("kept").select("outer_fold", "feature", r("corr_f", 6).alias("corr_f"))


@query("x07_select_features", f"""
WITH {PREP} SELECT outer_fold, feature, row_number() OVER (PARTITION BY outer_fold ORDER BY round(anova_f, 9) DESC NULLS LAST, pos DESC) AS rank FROM state WHERE kept QUALIFY rank <= 20""")
def x07(spark, sf):
    return prep.select(state(spark, sf), "anova_f", 20).select("outer_fold", "feature", F.col("rank").cast("long").alias("rank"))


# The range of imputed training values is that of the values themselves: a median lies between them.
@query("x08_quantize", f"""
WITH {FOLDED}, state AS (SELECT o AS outer_fold, feature, coalesce(quantile_cont(value, 0.5), 0) AS median, coalesce(min(value), 0) AS qmin, coalesce(max(value), 0) AS qmax
  FROM folded, (SELECT unnest([1, 2, 3, 4, 5]) AS o) WHERE fold <> o GROUP BY o, feature)
SELECT f.vec_id, f.feature, f.fold, CASE WHEN qmax > qmin THEN CAST(greatest(0, least(10, floor((coalesce(value, median) - qmin) / (qmax - qmin) * 11))) AS INTEGER) ELSE 0 END AS level
FROM folded f JOIN state s ON f.fold = s.outer_fold AND f.feature = s.feature""")
def x08(spark, sf):
    q = prep.quantize(folded(spark, sf), state(spark, sf), "fold", 11)
    return q.select("vec_id", "feature", "fold", "level")


@query("x09_pca")
def x09(spark, sf):
    v = vectors(spark, sf).select("vec_id", array_to_vector("vec").alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="pcs").fit(v)
    out = model.transform(v).select("vec_id", vector_to_array("pcs").alias("pcs"))
    return out.select("vec_id", F.get("pcs", F.lit(0)).alias("pc1"), F.get("pcs", F.lit(1)).alias("pc2"))


@query("x10_apply_state", f"""
WITH {PREP}
SELECT f.vec_id, f.feature, round((coalesce(value, median) - mean) / sd, 6) + 0.0 AS scaled FROM folded f JOIN state s ON f.fold = s.outer_fold AND f.feature = s.feature WHERE kept
UNION ALL SELECT f.vec_id, s.feature, round((CAST(value IS NULL AS DOUBLE) - mean) / sd, 6) + 0.0 FROM folded f JOIN state s ON f.fold = s.outer_fold AND s.feature = 'missingindicator_' || f.feature WHERE kept""")
def x10(spark, sf):
    t = prep.transform(folded(spark, sf), state(spark, sf), "fold")
    return t.select("vec_id", "feature", r("scaled", 6).alias("scaled"))
