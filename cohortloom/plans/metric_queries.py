"""Aggregations, windows, sorts and sets."""
from __future__ import annotations


from pyspark.sql import functions as F

from cohortloom.operators import audit, metrics, ordered, tables

from .inputs import FEATURES, PREDICTIONS, SAMPLES, SEEDS, features, predictions, r, samples, table
from .registry import query

# --- SQL twins of the metric blocks ------------------------------------------------------------


def class_sql(src: str, keys: str, t: str = "y_true", p: str = "y_pred") -> str:
    per = ", ".join(
        f"count(CASE WHEN {t} = {k} AND {p} = {k} THEN 1 END) AS tp{k}, count(CASE WHEN {t} = {k} THEN 1 END) AS sup{k}, count(CASE WHEN {p} = {k} THEN 1 END) AS pos{k}"
        for k in range(4)
    )
    f1 = [f"(CASE WHEN sup{k} + pos{k} > 0 THEN 2 * tp{k} / (sup{k} + pos{k}) ELSE 0 END)" for k in range(4)]
    rec = [f"(CASE WHEN sup{k} > 0 THEN tp{k} / sup{k} ELSE 0 END)" for k in range(4)]
    prec = [f"(CASE WHEN pos{k} > 0 THEN tp{k} / pos{k} ELSE 0 END)" for k in range(4)]
    seen = " + ".join(f"CAST(sup{k} + pos{k} > 0 AS INTEGER)" for k in range(4))
    held = " + ".join(f"CAST(sup{k} > 0 AS INTEGER)" for k in range(4))
    g = f"GROUP BY {keys}" if keys else ""
    ks = f"{keys}, " if keys else ""
    return f"""SELECT {ks}n AS rows, round(({' + '.join(f1)}) / 4, 8) AS macro_f1, round(({' + '.join(f1)}) / ({seen}), 8) AS macro_f1_observed,
  round(({' + '.join(f'{f1[k]} * sup{k}' for k in range(4))}) / n, 8) AS weighted_f1, round(({' + '.join(rec)}) / ({held}), 8) AS balanced_accuracy,
  round(hit / n, 8) AS accuracy, round(severe / n, 8) AS severe_error_rate, round(near / n, 8) AS adjacent_accuracy, extreme AS extreme_confusions,
  CASE WHEN t2 + p2 - 2 * st * sp / n > 0 THEN round(1 - d2 / (t2 + p2 - 2 * st * sp / n), 8) + 0.0 END AS quadratic_weighted_kappa,
  {', '.join(f'round({rec[k]}, 8) AS recall_{k}' for k in range(4))}, {', '.join(f'round({prec[k]}, 8) AS precision_{k}' for k in range(4))}
FROM (SELECT {ks}count(*) AS n, count(CASE WHEN {t} = {p} THEN 1 END) AS hit, count(CASE WHEN abs({t} - {p}) >= 2 THEN 1 END) AS severe,
  count(CASE WHEN abs({t} - {p}) <= 1 THEN 1 END) AS near, count(CASE WHEN abs({t} - {p}) = 3 THEN 1 END) AS extreme,
  sum(({t} - {p}) * ({t} - {p}))::DOUBLE AS d2, sum({t})::DOUBLE AS st, sum({p})::DOUBLE AS sp, sum({t} * {t})::DOUBLE AS t2, sum({p} * {p})::DOUBLE AS p2, {per} FROM {src} {g})"""


METRIC_COLS = [
    "macro_f1", "macro_f1_observed", "weighted_f1", "balanced_accuracy", "accuracy", "severe_error_rate", "adjacent_accuracy",
    "quadratic_weighted_kappa", *[f"recall_{k}" for k in range(4)], *[f"precision_{k}" for k in range(4)],
]


def rounded_metrics(df, keys):
    return df.select(*keys, "rows", "extreme_confusions", *[r(c).alias(c) for c in METRIC_COLS])


OOF = PREDICTIONS + """, seed_mean AS (
  SELECT subject, condition, event_id, model, any_value(y_true) AS y_true, any_value(target_score) AS target_score,
    [round(avg(scores[1]), 9), round(avg(scores[2]), 9), round(avg(scores[3]), 9), round(avg(scores[4]), 9)] AS scores, round(avg(y_pred_raw), 9) AS y_pred_raw
  FROM predictions GROUP BY subject, condition, event_id, model),
oof AS (SELECT *, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS y_pred, greatest(1.0::DOUBLE, least(4.0::DOUBLE, y_pred_raw)) AS y_pred_bounded FROM seed_mean)"""


def oof(spark, sf):
    return metrics.canonicalize(
        predictions(spark, sf), ["subject", "condition", "event_id", "model"], SEEDS, ["y_true", "target_score"]
    )


def spearman_sql(src: str, keys: str, x: str, y: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    px, py = (f"PARTITION BY {keys}, {c}" if keys else f"PARTITION BY {c}" for c in (x, y))
    g = f"GROUP BY {keys}" if keys else ""
    ks = f"{keys}, " if keys else ""
    return f"""SELECT {ks}CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN round(corr(rx, ry), 7) + 0.0 END AS spearman FROM (
  SELECT {ks}rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({px}) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({py}) - 1) / 2.0::DOUBLE AS ry FROM {src}) {g}"""


# --- availability ------------------------------------------------------------------------------

STREAMS = ["click", "error", "purchase", "signup", "view"]
AVAIL = "strong AS (SELECT DISTINCT subject, stream FROM samples WHERE value > 120)"
AVAIL_WIDE = "avail AS (SELECT subject, " + ", ".join(f"bool_or(stream = '{s}') AS has_{s}" for s in STREAMS) + ", string_agg(stream, ';' ORDER BY stream) AS modalities, count(*) AS n FROM strong GROUP BY subject)"


def availability(spark, sf):
    return audit.availability(samples(spark, sf).where("value > 120"), ["subject"], "stream", STREAMS)


@query("b01_availability", f"WITH {SAMPLES}, {AVAIL}, {AVAIL_WIDE} SELECT * FROM avail")
def b01(spark, sf):
    return availability(spark, sf)


@query("b02_coverage", f"""
WITH {SAMPLES}, {AVAIL}, {AVAIL_WIDE}, long AS (SELECT subject, unnest({STREAMS!r}) AS modality, modalities FROM avail),
c AS (SELECT modality, count(*) AS runs, count(CASE WHEN contains(modalities, modality) THEN 1 END) AS available FROM long GROUP BY modality),
d AS (SELECT count(CASE WHEN n = 5 THEN 1 END) AS strict_complete, count(CASE WHEN has_click AND has_view THEN 1 END) AS core_complete FROM avail)
SELECT modality, runs, available, runs - available AS missing, round(100.0 * available / runs, 6) AS percent, strict_complete, core_complete FROM c, d""")
def b02(spark, sf):
    c = audit.coverage(availability(spark, sf), STREAMS, core=["click", "view"])
    return c.withColumn("percent", r("percent", 6))


@query("b03_distribution", """
SELECT coalesce(grp, '<missing>') AS grp, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share
FROM (SELECT CASE WHEN n_chars > 300 THEN lang END AS grp FROM documents) GROUP BY 1""")
def b03(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("n_chars") > 300, F.col("lang")).alias("grp"))
    return audit.distribution(d, "grp").withColumn("share", r("share"))


# --- metrics -----------------------------------------------------------------------------------


@query("b04_classification_metrics", f"WITH {PREDICTIONS} {class_sql('predictions', 'model, condition, seed')}")
def b04(spark, sf):
    keys = ["model", "condition", "seed"]
    return rounded_metrics(metrics.classification_metrics(predictions(spark, sf), keys), keys)


_CELLS = " || ',' || ".join(
    "'[' || " + " || ',' || ".join(f"count(CASE WHEN y_true = {t} AND y_pred = {p} THEN 1 END)" for p in range(4)) + " || ']'" for t in range(4)
)


@query("b05_confusion", f"WITH {PREDICTIONS} SELECT model, condition, '[' || {_CELLS} || ']' AS confusion_matrix FROM predictions GROUP BY model, condition")
def b05(spark, sf):
    return metrics.confusion(predictions(spark, sf), ["model", "condition"])


@query("b06_severe_errors", f"""
WITH {PREDICTIONS} SELECT model, subject, round(avg(CAST(abs(y_true - y_pred) >= 2 AS DOUBLE)), 8) AS severe_error_rate,
  round(avg(CAST(abs(y_true - y_pred) <= 1 AS DOUBLE)), 8) AS adjacent_accuracy, count(CASE WHEN abs(y_true - y_pred) = 3 THEN 1 END) AS extreme_confusions
FROM predictions GROUP BY model, subject""")
def b06(spark, sf):
    m = metrics.classification_metrics(predictions(spark, sf), ["model", "subject"])
    return m.select("model", "subject", r("severe_error_rate").alias("severe_error_rate"), r("adjacent_accuracy").alias("adjacent_accuracy"), "extreme_confusions")


@query("b07_weighted_kappa", f"""
WITH {PREDICTIONS}, o AS (SELECT model, y_true, y_pred, count(*) AS o FROM predictions GROUP BY ALL),
tm AS (SELECT model, y_true, sum(o) AS a FROM o GROUP BY ALL), pm AS (SELECT model, y_pred, sum(o) AS b FROM o GROUP BY ALL), n AS (SELECT model, sum(o) AS n FROM o GROUP BY ALL),
e AS (SELECT tm.model, sum((y_true - y_pred) ** 2 * a * b / n) AS e FROM tm JOIN pm ON tm.model = pm.model JOIN n ON tm.model = n.model GROUP BY tm.model),
w AS (SELECT model, sum((y_true - y_pred) ** 2 * o) AS w FROM o GROUP BY model)
SELECT w.model, round(1 - w / e, 8) AS quadratic_weighted_kappa FROM w JOIN e ON w.model = e.model""")
def b07(spark, sf):
    m = metrics.classification_metrics(predictions(spark, sf), ["model"])
    return m.select("model", r("quadratic_weighted_kappa").alias("quadratic_weighted_kappa"))


_RC = "greatest(0, least(3, CAST(round_even({c}, 0) AS INTEGER) - 1))"
REG_SQL = f"""count(*) AS rows, round(avg(abs(target_score - y_pred_raw)), 8) AS raw_mae, round(avg(abs(target_score - y_pred_bounded)), 8) AS bounded_mae,
  round(sqrt(avg((target_score - y_pred_bounded) ** 2)), 8) AS bounded_rmse,
  CASE WHEN var_pop(target_score) > 0 THEN round(1 - avg((target_score - y_pred_bounded) ** 2) / var_pop(target_score), 8) END AS bounded_r2,
  count(CASE WHEN abs(y_pred_raw - y_pred_bounded) > 1e-12 THEN 1 END) AS clip_count, round(avg(CAST(abs(y_pred_raw - y_pred_bounded) > 1e-12 AS DOUBLE)), 8) AS clip_rate,
  round(avg(CAST(abs({_RC.format(c='target_score')} - {_RC.format(c='y_pred_bounded')}) >= 2 AS DOUBLE)), 8) AS severe_error_rate"""


@query("b08_regression_metrics", f"""
WITH {PREDICTIONS}, m AS (SELECT model, condition, {REG_SQL} FROM predictions GROUP BY model, condition),
s AS ({spearman_sql('predictions', 'model, condition', 'target_score', 'y_pred_bounded')})
SELECT m.*, s.spearman FROM m JOIN s ON m.model = s.model AND m.condition = s.condition""")
def b08(spark, sf):
    m = metrics.regression_metrics(predictions(spark, sf), ["model", "condition"])
    num = ["raw_mae", "bounded_mae", "bounded_rmse", "bounded_r2", "clip_rate", "severe_error_rate"]
    return m.select("model", "condition", "rows", "clip_count", *[r(c).alias(c) for c in num], r("spearman", 7).alias("spearman"))


_LEVELS = ", ".join(
    f"count(CASE WHEN target_score = {k} THEN 1 END) AS level_{k}_rows, round(avg(CASE WHEN target_score = {k} THEN abs(target_score - y_pred_bounded) END), 8) + 0.0 AS level_{k}_mae, "
    f"round(avg(CASE WHEN target_score = {k} THEN y_pred_bounded END), 8) AS level_{k}_mean, round(stddev_pop(CASE WHEN target_score = {k} THEN y_pred_bounded END), 7) + 0.0 AS level_{k}_std"
    for k in range(1, 5)
)


@query("b09_regression_diagnostics", f"""
WITH {PREDICTIONS} SELECT model, condition, round(avg(y_pred_bounded), 8) AS prediction_mean, round(stddev_pop(y_pred_bounded), 7) AS prediction_std,
  round(max(y_pred_bounded) - min(y_pred_bounded), 8) AS prediction_range, round(avg(abs(y_pred_bounded - 2.5)), 8) AS midpoint_distance,
  count(DISTINCT {_RC.format(c='y_pred_bounded')}) AS rounded_levels, round(avg(CAST(abs(target_score - y_pred_bounded) <= 1 AS DOUBLE)), 8) AS adjacent_accuracy,
  round(avg(CAST(abs(target_score - y_pred_bounded) >= 2 AS DOUBLE)), 8) AS severe_error_rate, round(stddev_samp(y_pred_bounded) / stddev_samp(target_score), 7) AS mean_collapse_ratio, {_LEVELS}
FROM predictions GROUP BY model, condition""")
def b09(spark, sf):
    d = metrics.regression_diagnostics(predictions(spark, sf), ["model", "condition"])
    ints = {"rounded_levels", *[f"level_{k}_rows" for k in range(1, 5)]}
    seven = {"prediction_std", "mean_collapse_ratio", *[f"level_{k}_std" for k in range(1, 5)]}
    return d.select("model", "condition", *[
        F.col(c) if c in ints else r(c, 7 if c in seven else 8).alias(c) for c in d.columns if c not in ("model", "condition")
    ])


@query("b10_head_agreement", f"""
WITH {PREDICTIONS} SELECT model, seed, round(avg(CAST(y_pred = {_RC.format(c='y_pred_bounded')} AS DOUBLE)), 8) AS agreement_rate,
  round(avg(abs(y_pred + 1 - y_pred_bounded)), 8) AS mean_abs_difference, round(avg(abs(y_pred_bounded - round_even(y_pred_bounded, 0))), 8) AS integer_distance
FROM predictions GROUP BY model, seed""")
def b10(spark, sf):
    a = metrics.head_agreement(predictions(spark, sf), ["model", "seed"])
    return a.select("model", "seed", *[r(c).alias(c) for c in ("agreement_rate", "mean_abs_difference", "integer_distance")])


@query("b11_canonical_oof", f"""
WITH {OOF} SELECT subject, condition, event_id, model, y_true, y_pred, round(list_max(scores), 8) + 0.0 AS confidence, y_pred_raw + 0.0 AS y_pred_raw, y_pred_bounded FROM oof""")
def b11(spark, sf):
    return oof(spark, sf).select(
        "subject", "condition", "event_id", "model", "y_true", "y_pred", r("confidence").alias("confidence"), r("y_pred_raw", 9).alias("y_pred_raw"), "y_pred_bounded"
    )


@query("b12_seed_stability", f"""
WITH {PREDICTIONS}, m AS ({class_sql('predictions', 'model, condition, seed')})
SELECT model, condition, count(*) AS seeds, round(avg(macro_f1), 7) AS mean, round(stddev_samp(macro_f1), 7) AS sd, round(median(macro_f1), 7) AS median,
  round(min(macro_f1), 7) AS min, round(max(macro_f1), 7) AS max, round(max(macro_f1) - min(macro_f1), 7) AS range FROM m GROUP BY model, condition""")
def b12(spark, sf):
    m = metrics.classification_metrics(predictions(spark, sf), ["model", "condition", "seed"]).withColumn("macro_f1", r("macro_f1"))
    s = metrics.seed_stability(m, ["model", "condition"], "macro_f1")
    return s.select("model", "condition", "seeds", *[r(c, 7).alias(c) for c in ("mean", "sd", "median", "min", "max", "range")])


GRAINS = [["model"], ["model", "condition"], ["model", "seed"], ["model", "subject"]]


@query("b13_metrics_rollup", f"""
WITH {PREDICTIONS}, p AS (SELECT model, condition, CAST(seed AS VARCHAR) AS seed, CAST(subject AS VARCHAR) AS subject, y_true, y_pred FROM predictions),
g AS (SELECT model, 'ALL' AS condition, 'ALL' AS seed, 'ALL' AS subject, y_true, y_pred FROM p UNION ALL
  SELECT model, condition, 'ALL', 'ALL', y_true, y_pred FROM p UNION ALL SELECT model, 'ALL', seed, 'ALL', y_true, y_pred FROM p UNION ALL
  SELECT model, 'ALL', 'ALL', subject, y_true, y_pred FROM p)
{class_sql('g', 'model, condition, seed, subject')}""")
def b13(spark, sf):
    dims = ["model", "condition", "seed", "subject"]
    return rounded_metrics(metrics.metrics_rollup(predictions(spark, sf), dims, GRAINS), dims)


# --- data quality ------------------------------------------------------------------------------


@query("b14_missingness", f"""
WITH {FEATURES} SELECT feature, count(*) AS rows, count(*) - count(value) AS missing_count, round((count(*) - count(value)) / count(*), 8) AS missing_ratio,
  count(value) = 0 AS fully_missing FROM gappy GROUP BY feature""")
def b14(spark, sf):
    m = audit.missingness(features(spark, sf, missing=True), ["feature"], "value")
    return m.withColumn("missing_ratio", r("missing_ratio"))


@query("b15_constant_features", f"""
WITH {FEATURES}, f AS (SELECT feature, CASE WHEN pos = 60 THEN NULL WHEN pos = 61 THEN 1.5::DOUBLE ELSE value END AS value FROM gappy)
SELECT feature, CASE WHEN count(value) = 0 THEN 'all_missing' WHEN count(DISTINCT value) = 1 THEN 'single_value' ELSE 'varied' END AS status,
  CASE WHEN count(DISTINCT value) = 1 THEN any_value(value) END AS constant_value FROM f GROUP BY feature""")
def b15(spark, sf):
    f = features(spark, sf, missing=True)
    v = F.when(F.col("pos") == 60, F.lit(None).cast("double")).when(F.col("pos") == 61, F.lit(1.5)).otherwise(F.col("value"))
    return audit.constant_features(f.withColumn("value", v), ["feature"], "value")


@query("b16_integrity", """
WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL)
SELECT count(*) AS keys, count(CASE WHEN copies > 1 THEN 1 END) AS duplicate_keys, coalesce(sum(CASE WHEN copies > 1 THEN copies END), 0)::BIGINT AS rows_in_duplicates,
  (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_keys,
  (SELECT count(*) FROM lineitem WHERE isinf(l_quantity) OR isinf(l_extendedprice)) AS infinite_rows FROM d""")
def b16(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return audit.integrity(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])


@query("b16_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def b16_dups(spark, sf):
    return audit.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("b17_efficiency", """
SELECT l_returnflag, l_linestatus, count(*) AS units, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 8) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median,
  max(l_quantity) AS max, round(sum(l_extendedprice) / sum(l_quantity), 6) AS throughput FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def b17(spark, sf):
    e = audit.efficiency(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return e.select("l_returnflag", "l_linestatus", "units", r("total", 2).alias("total"), r("mean").alias("mean"), r("median", 6).alias("median"), "max", r("throughput", 6).alias("throughput"))


SUBJECT_F1 = f"subj AS (SELECT model, subject, macro_f1 FROM ({class_sql('oof', 'model, subject')}))"


def subject_f1(spark, sf):
    m = metrics.classification_metrics(oof(spark, sf), ["model", "subject"])
    return m.select("model", "subject", r("macro_f1").alias("macro_f1"))


@query("b18_subject_stability", f"""
WITH {OOF}, {SUBJECT_F1}
SELECT model, count(*) AS subjects, round(avg(macro_f1), 7) AS mean, round(stddev_samp(macro_f1), 7) AS sd, round(quantile_cont(macro_f1, 0.5), 7) AS median, round(quantile_cont(macro_f1, 0.25), 7) AS q1,
  round(quantile_cont(macro_f1, 0.75), 7) AS q3, round(quantile_cont(macro_f1, 0.75) - quantile_cont(macro_f1, 0.25), 7) AS iqr, round(min(macro_f1), 7) AS min, round(max(macro_f1), 7) AS max,
  round(stddev_samp(macro_f1) / abs(avg(macro_f1)), 7) AS cv, arg_max(subject, macro_f1 * 1e9 - subject / 1e6) AS best_subject, arg_min(subject, macro_f1 * 1e9 + subject / 1e6) AS worst_subject
FROM subj GROUP BY model""")
def b18(spark, sf):
    s = metrics.subject_stability(subject_f1(spark, sf), ["model"], "subject", "macro_f1")
    return s.select("model", "subjects", "best_subject", "worst_subject", *[r(c, 7).alias(c) for c in ("mean", "sd", "median", "q1", "q3", "iqr", "min", "max", "cv")])


@query("b18_instability_flag", f"""
WITH {PREDICTIONS}, m AS (SELECT model, subject, seed, macro_f1 FROM ({class_sql('predictions', 'model, subject, seed')})),
v AS (SELECT model, subject, round(stddev_samp(macro_f1), 7) AS sd FROM m GROUP BY model, subject)
SELECT v.model, subject, sd, sd >= q AS unstable FROM v JOIN (SELECT model, quantile_cont(sd, 0.75) AS q FROM v GROUP BY model) t ON v.model = t.model""")
def b18_flag(spark, sf):
    m = metrics.classification_metrics(predictions(spark, sf), ["model", "subject", "seed"]).withColumn("macro_f1", r("macro_f1"))
    v = metrics.seed_stability(m, ["model", "subject"], "macro_f1").select("model", "subject", r("sd", 7).alias("sd"))
    return metrics.flag_top_quartile(v, ["model"], "sd")


@query("b19_by_stratum", f"""
WITH {OOF}, {AVAIL}, o AS (SELECT o.*, s.subject IS NOT NULL AS available FROM oof o LEFT JOIN strong s ON o.subject = s.subject AND o.condition = s.stream)
{class_sql('o', 'condition, available')}""")
def b19(spark, sf):
    strong = samples(spark, sf).where("value > 120").select("subject", F.col("stream").alias("condition")).distinct().withColumn("available", F.lit(True))
    o = oof(spark, sf).join(strong, ["subject", "condition"], "left").withColumn("available", F.coalesce("available", F.lit(False)))
    keys = ["condition", "available"]
    return rounded_metrics(metrics.classification_metrics(o, keys), keys)


@query("b20_correlation_report", f"""
WITH {OOF}, m AS (SELECT model, round(corr(target_score, y_pred_raw), 7) AS pearson, round(avg((target_score - y_pred_raw) ** 2), 7) AS mse, count(*) AS rows FROM oof GROUP BY model),
s AS ({spearman_sql('oof', 'model', 'target_score', 'y_pred_raw')}) SELECT m.*, spearman FROM m JOIN s ON m.model = s.model""")
def b20(spark, sf):
    c = metrics.corr_report(oof(spark, sf), ["model"], "target_score", "y_pred_raw")
    return c.select("model", "rows", r("pearson", 7).alias("pearson"), r("mse", 7).alias("mse"), r("spearman", 7).alias("spearman"))


ROC = """lab AS (SELECT n_chars AS score, quality FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
per AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM lab GROUP BY score),
run AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM per),
pts AS (SELECT score AS threshold, tp / p AS tpr, fp / n AS fpr, pos / p AS dy, neg / n AS dx FROM run)"""


def _roc(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return metrics.roc_points(d, "n_chars", F.col("quality") == 1)


@query("b21_roc_curve", f"WITH {ROC} SELECT threshold, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr FROM pts")
def b21(spark, sf):
    return _roc(spark, sf).select("threshold", r("tpr").alias("tpr"), r("fpr").alias("fpr"))


@query("b21_roc_auc", f"WITH {ROC} SELECT round(sum(dx * (tpr - dy / 2)), 8) AS auc, count(*) AS points FROM pts")
def b21_auc(spark, sf):
    return metrics.roc_auc(_roc(spark, sf)).withColumn("auc", r("auc"))


@query("b22_by_subject", f"WITH {SAMPLES} SELECT subject, round(avg(value), 8) AS mean, round(stddev_pop(value), 7) AS std, count(*) AS n FROM samples WHERE stream = 'view' GROUP BY subject")
def b22(spark, sf):
    s = samples(spark, sf).where("stream = 'view'")
    return s.groupBy("subject").agg(r(F.avg("value")).alias("mean"), r(F.stddev_pop("value"), 7).alias("std"), F.count(F.lit(1)).alias("n"))


# --- windows -----------------------------------------------------------------------------------


@query("w01_average_ranks", f"""
WITH {SAMPLES}, k AS (SELECT stream, abs(k - 50) AS d FROM samples)
SELECT DISTINCT stream, d, rank() OVER (PARTITION BY stream ORDER BY d) + (count(*) OVER (PARTITION BY stream, d) - 1) / 2.0::DOUBLE AS avg_rank, count(*) OVER (PARTITION BY stream, d) AS ties FROM k""")
def w01(spark, sf):
    s = samples(spark, sf).select("stream", F.abs(F.col("k") - 50).alias("d"))
    return ordered.average_ranks(s, ["stream"], "d").select("stream", "d", "avg_rank", F.col("_count").alias("ties"))


@query("w02_shared_rank", f"""
WITH {OOF}, m AS (SELECT model, condition, round(macro_f1, 2) AS f1, round(severe_error_rate, 2) AS sev FROM ({class_sql('oof', 'model, condition')}))
SELECT model, condition, f1, sev, rank() OVER (PARTITION BY model ORDER BY f1 DESC, sev) AS rank FROM m""")
def w02(spark, sf):
    m = metrics.classification_metrics(oof(spark, sf), ["model", "condition"]).select(
        "model", "condition", F.round("macro_f1", 2).alias("f1"), F.round("severe_error_rate", 2).alias("sev")
    )
    return tables.shared_rank(m, ["model"], [("f1", False), ("sev", True)], "condition").withColumn("rank", F.col("rank").cast("long"))


@query("w03_running_max", f"""
WITH {SAMPLES} SELECT event_id, subject, max(value) OVER (PARTITION BY subject ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS running_max FROM samples""")
def w03(spark, sf):
    s = ordered.running(samples(spark, sf), ["subject"], ["t", "event_id"], {"running_max": ("max", "value")})
    return s.select("event_id", "subject", "running_max")


@query("w04_lag_lead", f"""
WITH {SAMPLES} SELECT event_id, lag(value) OVER w AS prev_value, lead(value) OVER w AS next_value, round(value - lag(value) OVER w, 8) + 0.0 AS diff
FROM samples WINDOW w AS (PARTITION BY subject, stream ORDER BY t, event_id)""")
def w04(spark, sf):
    keys, order = ["subject", "stream"], ["t", "event_id"]
    b = ordered.with_neighbors(samples(spark, sf), keys, order, {"prev_value": "value"}, {"next_value": "value"})
    return b.select("event_id", "prev_value", "next_value", r(F.col("value") - F.col("prev_value")).alias("diff"))


@query("w05_group_quantile", f"""
WITH {SAMPLES}, q AS (SELECT stream, quantile_cont(value, 0.75) AS q3 FROM samples GROUP BY stream)
SELECT event_id, s.stream, value >= q3 AS unstable FROM samples s JOIN q ON s.stream = q.stream""")
def w05(spark, sf):
    return metrics.flag_top_quartile(samples(spark, sf), ["stream"], "value").select("event_id", "stream", "unstable")


@query("w06_best_candidate", f"""
WITH {PREDICTIONS}, m AS (SELECT model, condition, seed, macro_f1, severe_error_rate, balanced_accuracy FROM ({class_sql('predictions', 'model, condition, seed')}))
SELECT model, condition, seed, macro_f1, severe_error_rate, balanced_accuracy FROM m
QUALIFY row_number() OVER (PARTITION BY model, condition ORDER BY macro_f1 DESC, balanced_accuracy DESC, severe_error_rate, seed) = 1""")
def w06(spark, sf):
    m = rounded_metrics(metrics.classification_metrics(predictions(spark, sf), ["model", "condition", "seed"]), ["model", "condition", "seed"])
    m = m.select("model", "condition", "seed", "macro_f1", "severe_error_rate", "balanced_accuracy")
    return metrics.best_per_group(m, ["model", "condition"], [("macro_f1", False), ("balanced_accuracy", False), ("severe_error_rate", True), ("seed", True)])


@query("w07_row_numbers", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def w07(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ordered.row_numbers(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


# --- sorts and top-k ---------------------------------------------------------------------------


@query("t01_stable_sort", f"WITH {SAMPLES} SELECT subject, stream, t, event_id, value FROM samples ORDER BY subject, stream, t, event_id")
def t01(spark, sf):
    return tables.stable_sort(samples(spark, sf).select("subject", "stream", "t", "event_id", "value"), ["subject", "stream", "t", "event_id"])


FSCORE = "fs AS (SELECT feature, pos, round(avg(value * target_class), 3) AS score FROM features GROUP BY feature, pos)"


def feature_scores(spark, sf):
    return features(spark, sf).groupBy("feature", "pos").agg(r(F.avg(F.col("value") * F.col("target_class")), 3).alias("score"))


@query("t02_top_features", f"""
WITH {FEATURES}, {FSCORE} SELECT feature, score, row_number() OVER (ORDER BY score DESC NULLS LAST, pos DESC) AS rank FROM fs QUALIFY rank <= 10""")
def t02(spark, sf):
    return tables.rank_features(feature_scores(spark, sf), [], "score", "pos").where("rank <= 10").select("feature", "score", F.col("rank").cast("long").alias("rank"))


@query("t03_effective_k", f"""
WITH {FEATURES}, {FSCORE}, alive AS (SELECT * FROM fs WHERE abs(score) > 0.002), k AS (SELECT requested, CASE WHEN requested = 'all' THEN (SELECT count(*) FROM alive) ELSE least(CAST(replace(requested, 'all', '0') AS BIGINT), (SELECT count(*) FROM alive)) END AS effective_k
  FROM (SELECT unnest(['5', '50', 'all']) AS requested)), ranked AS (SELECT feature, row_number() OVER (ORDER BY score DESC, pos DESC) AS rank FROM alive)
SELECT requested, effective_k, feature, rank FROM ranked JOIN k ON rank <= effective_k""")
def t03(spark, sf):
    alive = feature_scores(spark, sf).where(F.abs("score") > 0.002)
    s = tables.select_top_k(alive, [], "score", "pos", [5, 50, "all"])
    return s.select("requested", "effective_k", "feature", F.col("rank").cast("long").alias("rank"))


@query("t04_top_groups", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total FROM documents GROUP BY source ORDER BY total DESC, source LIMIT 15")
def t04(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))
    return tables.top_n(d, [("total", False), ("source", True)], 15)


@query("t05_ranked_comparison", f"""
WITH {OOF}, m AS (SELECT model, condition, macro_f1 FROM ({class_sql('oof', 'model, condition')}))
SELECT model, condition, macro_f1, row_number() OVER w AS rank, round(macro_f1 - first_value(macro_f1) OVER w, 7) + 0.0 AS from_best FROM m WINDOW w AS (ORDER BY macro_f1 DESC, model, condition)""")
def t05(spark, sf):
    m = metrics.classification_metrics(oof(spark, sf), ["model", "condition"]).select("model", "condition", r("macro_f1").alias("macro_f1"))
    c = tables.ranked_comparison(m, "macro_f1", ["model", "condition"])
    return c.select("model", "condition", "macro_f1", F.col("rank").cast("long").alias("rank"), r("from_best", 7).alias("from_best"))


# --- sets --------------------------------------------------------------------------------------


@query("s01_union_unlike", "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL BY NAME SELECT page_id AS id, NULL::VARCHAR AS lang, url FROM pages")
def s01(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return tables.concat_unlike([d, table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")])


@query("s02_key_difference", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def s02(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return tables.key_sets(a, b, ["k"])


_GROUPS = """grp AS (SELECT p_name AS feature, p_type AS grp FROM part), cat AS (SELECT DISTINCT p_name AS feature FROM part WHERE p_size < 40 UNION SELECT DISTINCT p_brand FROM part)"""


@query("s03_group_cover", f"""
WITH {_GROUPS}, g AS (SELECT feature, count(DISTINCT grp) AS groups FROM grp GROUP BY feature)
SELECT coalesce(g.feature, c.feature) AS feature, coalesce(groups, 0) AS groups,
  CASE WHEN g.feature IS NULL THEN 'uncovered' WHEN c.feature IS NULL THEN 'unknown' WHEN groups > 1 THEN 'overlap' ELSE 'ok' END AS status FROM g FULL JOIN cat c ON g.feature = c.feature""")
def s03(spark, sf):
    p = table(spark, sf, "part")
    catalog = p.where("p_size < 40").select(F.col("p_name").alias("feature")).union(p.select("p_brand")).distinct()
    return tables.group_cover(p.select(F.col("p_name").alias("feature"), F.col("p_type").alias("grp")), "feature", "grp", catalog)


@query("s04_drop_duplicates", "SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey, l_linenumber")
def s04(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return tables.distinct_latest(li, ["l_orderkey", "l_linenumber"], "price")


@query("s05_snapshot_diff", """
WITH a AS (SELECT o_orderkey AS path, sha256(o_orderstatus || '|' || o_orderpriority) AS hash FROM orders WHERE o_totalprice > 50000),
b AS (SELECT o_orderkey AS path, sha256(o_orderstatus || '|' || CASE WHEN o_custkey % 10 = 0 THEN 'x' ELSE o_orderpriority END) AS hash FROM orders WHERE o_totalprice < 400000)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'modified' ELSE 'same' END AS change
FROM a FULL JOIN b ON a.path = b.path""")
def s05(spark, sf):
    o = table(spark, sf, "orders")
    sep = F.lit("|")
    before = o.where("o_totalprice > 50000").select(F.col("o_orderkey").alias("path"), F.sha2(F.concat("o_orderstatus", sep, "o_orderpriority"), 256).alias("hash"))
    pr = F.when(F.col("o_custkey") % 10 == 0, "x").otherwise(F.col("o_orderpriority"))
    after = o.where("o_totalprice < 400000").select(F.col("o_orderkey").alias("path"), F.sha2(F.concat("o_orderstatus", sep, pr), 256).alias("hash"))
    return tables.snapshot_diff(before, after, ["path"], "hash")
