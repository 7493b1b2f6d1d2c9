"""Audit, repair, leakage and evidence queries (Q01-Q12, Q18-Q24)."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.names import split_statistic
from cohortloom.operators import audit, metrics

from .inputs import FEATURES, PREDICTIONS, SAMPLES, features, predictions, r, samples, table
from .metric_queries import AVAIL, AVAIL_WIDE, OOF, STREAMS, availability, class_sql, oof, rounded_metrics
from .registry import query
from .scalars import _clean_sql
from .signals import RUN

FILE_AUDIT = """af AS (SELECT o_orderkey // 2 AS stem, o_orderkey // 24 AS run_key, CASE WHEN o_orderkey % 2 = 1 THEN 'hea' ELSE 'dat' END AS kind, o_orderstatus <> 'P' AS id_ok,
  CAST(floor(o_totalprice) AS BIGINT) % 40 AS data_rows, o_custkey % 50 AS sample_count, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS effective_rate FROM orders WHERE o_totalprice > 50000),
pairs AS (SELECT run_key, stem, max(CASE WHEN kind = 'dat' THEN 1 END) AS dat, max(CASE WHEN kind = 'hea' THEN 1 END) AS hea, bool_and(id_ok) AS ok,
  max(CASE WHEN kind = 'dat' THEN data_rows END) AS nrow, max(CASE WHEN kind = 'hea' THEN sample_count END) AS cnt, max(CASE WHEN kind = 'hea' THEN effective_rate END) AS rate FROM af GROUP BY run_key, stem),
coded AS (SELECT run_key, stem, list_sort(list_filter([CASE WHEN NOT ok THEN 'identifier_mismatch' END, CASE WHEN dat = 1 AND nrow = 0 THEN 'no_data_rows' END,
  CASE WHEN hea = 1 AND cnt <= 0 THEN 'invalid_sample_count' END, CASE WHEN hea = 1 AND rate <= 0 THEN 'invalid_effective_rate' END,
  CASE WHEN hea = 1 AND cnt > 0 AND rate > 0 AND cnt / rate < 30 THEN 'short_stream_metadata' END,
  CASE WHEN dat = 1 AND hea = 1 AND cnt = 0 AND nrow > 0 THEN 'placeholder_data_with_zero_samples' END,
  CASE WHEN dat = 1 AND hea IS NULL THEN 'missing_paired_header' END, CASE WHEN hea = 1 AND dat IS NULL THEN 'missing_paired_data' END], lambda x: x IS NOT NULL)) AS codes,
  dat = 1 AND nrow > 0 AND NOT coalesce(hea = 1 AND cnt = 0, false) AS verified FROM pairs)"""


def file_audit(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 50000")
    f = o.select(
        F.floor(F.col("o_orderkey") / 2).alias("stem"), F.floor(F.col("o_orderkey") / 24).alias("run_key"),
        F.when(F.col("o_orderkey") % 2 == 1, "hea").otherwise("dat").alias("kind"), (F.col("o_orderstatus") != "P").alias("id_ok"),
        (F.floor("o_totalprice") % 40).alias("data_rows"), (F.col("o_custkey") % 50).alias("sample_count"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("effective_rate"),
    )
    return audit.audit_files(f, ["run_key"], "stem")


@query("q01_file_audit", f"WITH {FILE_AUDIT} SELECT run_key, stem, coalesce(array_to_string(codes, ';'), '') AS codes, CAST(len(codes) AS BIGINT) AS code_count, coalesce(verified, false) AS verified FROM coded")
def q01(spark, sf):
    return file_audit(spark, sf).withColumn("verified", F.coalesce("verified", F.lit(False)))


@query("q01_run_audit", f"""
WITH {FILE_AUDIT}, runs AS (SELECT run_key, count(*) AS streams, count(CASE WHEN verified THEN 1 END) AS verified_streams, sum(len(codes))::BIGINT AS abnormal_count FROM coded GROUP BY run_key),
names AS (SELECT run_key, string_agg(DISTINCT code, ';' ORDER BY code) AS codes FROM (SELECT run_key, unnest(codes) AS code FROM coded) GROUP BY run_key)
SELECT runs.*, coalesce(codes, '') AS codes FROM runs LEFT JOIN names ON runs.run_key = names.run_key""")
def q01_runs(spark, sf):
    a = audit.audit_runs(file_audit(spark, sf), ["run_key"])
    return a.withColumn("codes", F.regexp_replace("codes", "^;", ""))


_PRIOR = f"""prior AS (SELECT subject, {', '.join(f"bool_or(stream = '{s}' AND value > 100) AS has_{s}" for s in STREAMS)} FROM samples WHERE k > 3 GROUP BY subject HAVING count(*) > 60)"""
FLAGS = [f"has_{s}" for s in STREAMS]


@query("q02_discrepancies", f"""
WITH {SAMPLES}, {AVAIL}, {AVAIL_WIDE}, {_PRIOR},
a AS (SELECT * FROM prior UNPIVOT (prior_flag FOR flag IN ({', '.join(FLAGS)}))),
b AS (SELECT subject, flag, v FROM (SELECT subject, {', '.join(FLAGS)} FROM avail) UNPIVOT (v FOR flag IN ({', '.join(FLAGS)}))),
j AS (SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.flag, b.flag) AS flag, CASE WHEN a.subject IS NULL THEN 'run_added' WHEN b.subject IS NULL THEN 'run_removed'
  WHEN NOT prior_flag AND v THEN 'added' WHEN prior_flag AND NOT v THEN 'removed' END AS change FROM a FULL JOIN b ON a.subject = b.subject AND a.flag = b.flag)
SELECT *, CASE WHEN change IN ('removed', 'run_removed') THEN 'high' ELSE 'medium' END AS severity FROM j WHERE change IS NOT NULL""")
def q02(spark, sf):
    s = samples(spark, sf).where("k > 3")
    prior = s.groupBy("subject").agg(
        *[F.bool_or((F.col("stream") == m) & (F.col("value") > 100)).alias(f"has_{m}") for m in STREAMS], F.count(F.lit(1)).alias("n")
    ).where("n > 60")
    return audit.discrepancies(prior, availability(spark, sf), ["subject"], FLAGS)


_SCHEDULE_SQL = "[" + ", ".join(f"{{'level': '{l}', 'run': '{n}'}}" for l, n in audit.EXPECTED_SCHEDULE) + "]"


@query("q03_schedule_variance", f"""
WITH exp AS (SELECT unnest({_SCHEDULE_SQL}) AS e), runs AS (
  SELECT DISTINCT o_custkey AS subject, '0' || (CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 4 + 1 ELSE (o_orderkey % 12) // 3 + 1 END) || 'B' AS level,
    lpad(CAST(CASE o_orderkey % 12 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 12 WHEN 3 THEN 3 WHEN 4 THEN 8 WHEN 5 THEN 10 WHEN 6 THEN 2 WHEN 7 THEN 5 WHEN 8 THEN 11 WHEN 9 THEN 4 WHEN 10 THEN 6 ELSE 9 END AS VARCHAR), 3, '0') AS run FROM orders),
subj AS (SELECT DISTINCT subject FROM runs)
SELECT s.subject, e.level AS level, e.run AS run, CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE r.subject = s.subject AND r.run = e.run) THEN 'schedule_mapping_hole' ELSE 'physically_absent_run' END AS status
FROM subj s, exp WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.subject = s.subject AND r.run = e.run AND r.level = e.level)
UNION ALL SELECT subject, level, run, 'unexpected' FROM runs r WHERE NOT EXISTS (SELECT 1 FROM exp WHERE e.level = r.level AND e.run = r.run)""")
def q03(spark, sf):
    o = table(spark, sf, "orders")
    slot = (F.col("o_orderkey") % 12).cast("int")
    level = F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") % 4 + 1).otherwise(F.floor(slot / 3) + 1)
    run = F.element_at(F.array(*[F.lit(n) for _, n in audit.EXPECTED_SCHEDULE]), slot + 1)
    # Schedule order: three runs per level, as listed in EXPECTED_SCHEDULE.
    runs = o.select(F.col("o_custkey").alias("subject"), F.concat(F.lit("0"), level.cast("string"), F.lit("B")).alias("level"), run.alias("run"))
    return audit.schedule_variance(runs, "subject", "level", "run")


@query("q03_schedule_by_task", """
WITH exp(task, level, run) AS (VALUES ('rest', '000', '001'), ('rest', '000', '002'), ('ils', '01B', '001'), ('ils', '01B', '007'), ('ils', '01B', '012'), ('ils', '02B', '003'),
  ('ils', '02B', '008'), ('ils', '02B', '010'), ('ils', '03B', '002'), ('ils', '03B', '005'), ('ils', '03B', '011'), ('ils', '04B', '004'), ('ils', '04B', '006'), ('ils', '04B', '009')),
runs AS (SELECT DISTINCT o_custkey AS subject, CASE o_orderpriority[1] WHEN '1' THEN 'rest' WHEN '5' THEN 'break' ELSE 'ils' END AS task,
    CASE o_orderpriority[1] WHEN '1' THEN '000' ELSE '0' || (o_orderkey % 5 + 1) || 'B' END AS level, lpad(CAST(o_orderkey % CASE o_orderpriority[1] WHEN '1' THEN 3 ELSE 13 END + 1 AS VARCHAR), 3, '0') AS run FROM orders),
subj AS (SELECT DISTINCT subject, task FROM runs)
SELECT subject, task, level, run, CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE r.subject = s.subject AND r.task = s.task AND r.run = e.run) THEN 'schedule_mapping_hole' ELSE 'physically_absent_run' END AS status
FROM subj s JOIN exp e USING (task) WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.subject = s.subject AND r.task = s.task AND r.run = e.run AND r.level = e.level)
UNION ALL SELECT subject, task, level, run, 'unexpected' FROM runs r WHERE NOT EXISTS (SELECT 1 FROM exp e WHERE e.task = r.task AND e.level = r.level AND e.run = r.run)""")
def q03_by_task(spark, sf):
    o = table(spark, sf, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    task = F.when(first == "1", "rest").when(first == "5", "break").otherwise("ils")
    level = F.when(first == "1", "000").otherwise(F.concat(F.lit("0"), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit("B")))
    run = F.lpad((F.col("o_orderkey") % F.when(first == "1", 3).otherwise(13) + 1).cast("string"), 3, "0")
    runs = o.select(F.col("o_custkey").alias("subject"), task.alias("task"), level.alias("level"), run.alias("run"))
    return audit.task_schedule_variance(runs, "subject", "task", "level", "run")


@query("q04_reconcile_summary", """
WITH a AS (SELECT doc_id, count(*) AS s FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS d FROM documents WHERE lang = 'en' GROUP BY doc_id)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN d IS NULL THEN 'only_summary' WHEN s IS NULL THEN 'only_detail' WHEN s > 1 THEN 'duplicate_in_summary' ELSE 'matched' END AS status,
  coalesce(d, 0) AS detail_rows FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def q04(spark, sf):
    lab = table(spark, sf, "labels")
    summary = lab.select("doc_id").unionAll(lab.where("toxic = 1").select("doc_id"))
    return audit.reconcile_summary(summary, table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), ["doc_id"])


LONG = """runfeat AS (SELECT subject, stream, round(avg(value), 8) AS mean_value, CAST(count(*) AS DOUBLE) AS sample_count FROM samples GROUP BY subject, stream),
before AS (SELECT subject, stream, 'mean' AS feature, CASE WHEN sample_count < 8 THEN NULL ELSE mean_value END AS value FROM runfeat UNION ALL SELECT subject, stream, 'count', sample_count FROM runfeat)"""


def long_before(spark, sf):
    f = samples(spark, sf).groupBy(*RUN).agg(r(F.avg("value")).alias("_m"), F.count(F.lit(1)).cast("double").alias("count"))
    f = f.select(*RUN, F.when(F.col("count") >= 8, F.col("_m")).alias("mean"), "count")
    return f.unpivot(RUN, ["mean", "count"], "feature", "value")


def strong(spark, sf):
    return samples(spark, sf).where("value > 120").select(*RUN).distinct()


@query("q05_mask_unavailable", f"""
WITH {SAMPLES}, {AVAIL}, {LONG}
SELECT b.subject, b.stream, feature, CASE WHEN s.subject IS NOT NULL THEN value END AS value, s.subject IS NULL AND value IS NOT NULL AS repaired
FROM before b LEFT JOIN strong s ON b.subject = s.subject AND b.stream = s.stream""")
def q05(spark, sf):
    return audit.mask_unavailable(long_before(spark, sf), strong(spark, sf), RUN, "value").select(*RUN, "feature", "value", "repaired")


@query("q06_change_containment", f"""
WITH {SAMPLES}, {AVAIL}, {LONG}, after AS (SELECT b.subject, b.stream, feature, CASE WHEN s.subject IS NOT NULL THEN value WHEN b.subject % 31 = 0 THEN value + 1 END AS value
  FROM before b LEFT JOIN strong s ON b.subject = s.subject AND b.stream = s.stream),
c AS (SELECT CASE WHEN b.value IS NOT DISTINCT FROM a.value THEN 'unchanged' WHEN s.subject IS NULL AND a.value IS NULL THEN 'allowed_blanked' ELSE 'violation_changed' END AS fate
  FROM before b JOIN after a ON b.subject = a.subject AND b.stream = a.stream AND b.feature = a.feature LEFT JOIN strong s ON b.subject = s.subject AND b.stream = s.stream)
SELECT fate, count(*) AS cells FROM c GROUP BY fate""")
def q06(spark, sf):
    before = long_before(spark, sf)
    ok = strong(spark, sf)
    masked = audit.mask_unavailable(before.withColumn("orig", F.col("value")), ok, RUN, "value")
    after = masked.withColumn("value", F.when(F.col("repaired") & (F.col("subject") % 31 == 0), F.col("orig") + 1).otherwise(F.col("value")))
    allowed = before.select(*RUN).distinct().join(ok, RUN, "left_anti")
    return audit.assert_changes(before, after, [*RUN, "feature"], "value", allowed, RUN)


GROUP_RULES = {"click_": "control_input_features", "view_": "eye_tracking_features", "error_": "performance_features", "purchase_": "flight_parameter_features"}
PROV = """longf AS (SELECT stream || '_' || CASE WHEN subject % 3 = 0 THEN 'mean' ELSE 'max' END AS feature, stream AS modality, CASE WHEN k < 50 THEN 'value' ELSE 'k' END AS source_column, CASE WHEN subject % 3 = 0 THEN 'mean' ELSE 'max' END AS statistic FROM samples
  UNION ALL SELECT 'shared_min', stream, 'value', 'min' FROM samples WHERE k = 7)"""


@query("q07_provenance", f"""
WITH {SAMPLES}, {PROV}
SELECT feature, string_agg(DISTINCT modality, ';' ORDER BY modality) AS modalities, string_agg(DISTINCT source_column, ';' ORDER BY source_column) AS source_columns,
  string_agg(DISTINCT statistic, ';' ORDER BY statistic) AS statistics,
  CASE WHEN starts_with(feature, 'click_') THEN 'control_input_features' WHEN starts_with(feature, 'view_') THEN 'eye_tracking_features' WHEN starts_with(feature, 'error_') THEN 'performance_features'
    WHEN starts_with(feature, 'purchase_') THEN 'flight_parameter_features' ELSE 'unknown_features' END AS feature_group,
  CASE WHEN count(DISTINCT modality) > 1 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS provenance_status FROM longf GROUP BY feature""")
def q07(spark, sf):
    s = samples(spark, sf)
    stat = F.when(F.col("subject") % 3 == 0, "mean").otherwise("max")
    a = s.select(
        F.concat_ws("_", "stream", stat).alias("feature"), F.col("stream").alias("modality"),
        F.when(F.col("k") < 50, "value").otherwise("k").alias("source_column"), stat.alias("statistic"),
    )
    b = s.where("k = 7").select(F.lit("shared_min").alias("feature"), F.col("stream").alias("modality"), F.lit("value").alias("source_column"), F.lit("min").alias("statistic"))
    return audit.provenance(a.unionAll(b), "feature", "modality", "source_column", "statistic", GROUP_RULES)


BEHAVIOURAL, SETTINGS = ["red", "blue", "green"], ["small", "large", "ring"]


@query("q08_semantic_category", f"""
WITH f AS (SELECT DISTINCT {_clean_sql('p_name')} AS base FROM part),
m AS (SELECT base, {' OR '.join(f"contains(base, '{w}')" for w in BEHAVIOURAL)} AS b, {' OR '.join(f"contains(base, '{w}')" for w in SETTINGS)} AS s FROM f)
SELECT base, 'mean' AS statistic, CASE WHEN b AND NOT s THEN 'BEHAVIORAL_RESPONSE' WHEN s AND NOT b THEN 'TASK_SETTING' ELSE 'AMBIGUOUS' END AS category FROM m""")
def q08(spark, sf):
    from cohortloom.functions.names import clean_name

    f = table(spark, sf, "part").select(F.concat(clean_name(F.col("p_name")), F.lit("_mean")).alias("feature")).distinct()
    f = f.select(split_statistic(F.col("feature")).alias("s")).select(F.col("s.base_variable").alias("base"), "s.statistic")
    return audit.semantic_category(f, "base", BEHAVIOURAL, SETTINGS)


@query("q09_leakage_decision", f"""
WITH {FEATURES}, d AS (SELECT feature, any_value(pos) AS pos, count(CASE WHEN pos = 60 THEN NULL ELSE value END) = 0 AS empty FROM gappy GROUP BY feature)
SELECT feature, CASE WHEN pos < 2 THEN 'EXCLUDE_ALL_MODEL_INPUTS' WHEN empty THEN 'EXCLUDE_ALL_DATASETS_STRUCTURALLY_UNUSABLE_ALL_NAN' WHEN pos % 13 = 5 THEN 'EXCLUDE_PRIMARY_UNVERIFIED'
  WHEN pos % 7 = 3 THEN 'EXCLUDE_PRIMARY_INCLUDE_AUXILIARY_AND_PERFORMANCE_ONLY' ELSE 'INCLUDE_PRIMARY' END AS decision FROM d""")
def q09(spark, sf):
    f = features(spark, sf, missing=True)
    d = f.groupBy("feature", "pos").agg((F.count(F.when(F.col("pos") != 60, F.col("value"))) == 0).alias("empty"))
    kind = F.when(F.col("pos") < 2, "identifier_or_target").otherwise("feature")
    group = F.when(F.col("pos") % 7 == 3, "performance_features").otherwise("other")
    return d.select("feature", audit.leakage_decision(kind, F.col("empty"), F.col("pos") % 13 != 5, group, "performance_features").alias("decision"))


FUNC = FEATURES + """, tf AS (SELECT feature, target_score, CASE pos WHEN 10 THEN target_score WHEN 11 THEN target_score * target_score WHEN 12 THEN 3.0::DOUBLE ELSE value END AS value FROM gappy),
per AS (SELECT feature, target_score, count(DISTINCT value) AS d, any_value(value) AS v, count(*) - count(value) AS gaps, bool_and(value = target_score) AS copy FROM tf GROUP BY feature, target_score)"""


@query("q10_target_functional", f"""
WITH {FUNC} SELECT feature, sum(gaps) = 0 AND bool_and(copy) AS direct_copy, sum(gaps) = 0 AND max(d) = 1 AND count(DISTINCT v) > 1 AS determined_by_target FROM per GROUP BY feature""")
def q10(spark, sf):
    f = features(spark, sf, missing=True)
    y = F.col("target_score")
    v = F.when(F.col("pos") == 10, y).when(F.col("pos") == 11, y * y).when(F.col("pos") == 12, 3.0).otherwise(F.col("value"))
    return audit.target_functional(f.withColumn("value", v), "feature", "value", "target_score")


@query("q11_cohort", """
SELECT o_orderkey, CAST(o_orderkey % 6 AS INTEGER) AS level, CASE WHEN o_orderkey % 6 BETWEEN 1 AND 4 THEN 'INCLUDE_TASK_COHORT' WHEN o_orderkey % 6 = 0 THEN 'EXCLUDE_REST_LEVEL' ELSE 'EXCLUDE_UNPARSED_LEVEL' END AS decision,
  CASE WHEN o_orderkey % 6 BETWEEN 1 AND 4 THEN '' WHEN o_orderkey % 6 = 0 THEN 'verified_rest_level' ELSE 'no_valid_level' END AS reason FROM orders""")
def q11(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).cast("int").alias("level"))
    return audit.cohort(o, "level", [1, 2, 3, 4])


@query("q12_feature_subset", f"WITH {FEATURES} SELECT vec_id, feature, value FROM features WHERE pos % 4 IN (1, 2)")
def q12(spark, sf):
    f = features(spark, sf)
    dim = f.select("feature", F.concat(F.lit("group_"), (F.col("pos") % 4).cast("string")).alias("feature_group")).distinct()
    return audit.select_features(f, dim, "feature", ["group_1", "group_2"]).select("vec_id", "feature", "value")


@query("q18_contract_gates", f"""
WITH {OOF}, g AS (SELECT count(*) > 0 AS has_rows, bool_and(y_pred BETWEEN 0 AND 3) AS legal_class, bool_and(y_pred_bounded BETWEEN 1 AND 4) AS bounded_score,
  count(y_pred) = count(*) AS no_missing, count(DISTINCT model) = 2 AS two_models, bool_and(y_true = y_pred) AS all_correct FROM oof)
SELECT gate, passed FROM g UNPIVOT (passed FOR gate IN (has_rows, legal_class, bounded_score, no_missing, two_models, all_correct))""")
def q18(spark, sf):
    return audit.gate_report(oof(spark, sf), {
        "has_rows": F.count(F.lit(1)) > 0, "legal_class": F.bool_and(F.col("y_pred").between(0, 3)),
        "bounded_score": F.bool_and(F.col("y_pred_bounded").between(1, 4)), "no_missing": F.count("y_pred") == F.count(F.lit(1)),
        "two_models": (F.min("model") == "HDC") & (F.max("model") == "TRADITIONAL"), "all_correct": F.bool_and(F.col("y_true") == F.col("y_pred")),
    })


INDEXED = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "labels": ["doc_id"], "documents": ["doc_id"], "conversations": ["conv_id", "turn"], "events": ["event_id"]}
_INDEX_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS artifact, sum(n)::BIGINT AS rows, count(*) AS distinct_keys, CASE WHEN sum(n) > count(*) THEN 'DUPLICATE_KEYS' ELSE 'PASS' END AS status FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(k)})"
    for t, k in INDEXED.items()
)


def evidence(spark, sf):
    return audit.evidence_index([audit.evidence_row(table(spark, sf, t).select(*k), t, k) for t, k in INDEXED.items()])


@query("q19_evidence_index", _INDEX_SQL)
def q19(spark, sf):
    return evidence(spark, sf)


@query("q24_coverage_rollup", f"""
WITH i AS ({_INDEX_SQL}), p AS (SELECT *, CASE WHEN artifact IN ('orders', 'lineitem') THEN 'sales' WHEN artifact = 'events' THEN 'signals' ELSE 'text' END AS phase FROM i)
SELECT phase, count(*) AS artifacts, sum(rows)::BIGINT AS rows, sum(distinct_keys)::BIGINT AS distinct_keys, string_agg(DISTINCT status, ';' ORDER BY status) AS statuses FROM p GROUP BY phase""")
def q24(spark, sf):
    phase = F.when(F.col("artifact").isin("orders", "lineitem"), "sales").when(F.col("artifact") == "events", "signals").otherwise("text")
    return audit.coverage_rollup(evidence(spark, sf).withColumn("phase", phase), "phase")


@query("q20_metric_recheck", f"""
WITH {PREDICTIONS}, a AS ({class_sql('predictions', 'model, condition')}),
j AS (SELECT a.model, a.macro_f1, a.accuracy, round(a.macro_f1, 3) AS f3, round(a.accuracy, 8) AS a8 FROM a)
SELECT 'macro_f1' AS metric, count(*) AS cells, 0::BIGINT AS unmatched, round(max(abs(macro_f1 - f3)), 8) AS max_abs_diff, max(abs(macro_f1 - f3)) <= 1e-6 AS passed FROM j
UNION ALL SELECT 'accuracy', count(*), 0, round(max(abs(accuracy - a8)), 8), max(abs(accuracy - a8)) <= 1e-6 FROM j""")
def q20(spark, sf):
    keys = ["model", "condition"]
    fresh = rounded_metrics(metrics.classification_metrics(predictions(spark, sf), keys), keys).select(*keys, "macro_f1", "accuracy")
    stored = fresh.withColumn("macro_f1", F.round("macro_f1", 3))
    return audit.metric_recheck(stored, fresh, keys, ["macro_f1", "accuracy"], 1e-6).withColumn("max_abs_diff", r("max_abs_diff"))


@query("q21_table_hash", """
WITH h AS (SELECT p_brand, ('0x' || substr(sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}'), 1, 15))::BIGINT AS h FROM part)
SELECT p_brand, count(*) AS rows, bit_xor(h) AS xor_hash, (sum(h % 1000000007) % 1000000007)::BIGINT AS sum_hash FROM h GROUP BY p_brand""")
def q21(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    return audit.table_hash(p, ["p_brand"])


@query("q22_holdout_feasibility", """
WITH d AS (SELECT o_orderpriority AS grp, o_custkey AS unit, o_orderstatus AS label FROM orders),
g AS (SELECT grp, count(DISTINCT unit) AS units, count(DISTINCT label) AS labels FROM d GROUP BY grp), u AS (SELECT max(n) = 1 AS one FROM (SELECT count(DISTINCT grp) AS n FROM d GROUP BY unit))
SELECT count(*) AS groups, min(units) AS min_units, max(units) AS max_units, count(CASE WHEN labels = (SELECT count(DISTINCT label) FROM d) THEN 1 END) AS groups_with_every_label,
  max(labels) = 1 AS determines_label, max(units) = 1 AS nested_in_unit, any_value(one) AS one_group_per_unit FROM g, u""")
def q22(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("unit"), F.col("o_orderstatus").alias("label"))
    return audit.holdout_feasibility(o, "grp", "unit", "label", 3)


_COND = """members AS (SELECT 0 AS position, 'FULL' AS condition, p_name AS feature FROM part UNION ALL SELECT 1, 'SMALL', p_name FROM part WHERE p_size < 10
  UNION ALL SELECT 2, 'SMALL_AGAIN', p_name FROM part WHERE p_size <= 9 UNION ALL SELECT 3, 'EMPTY', NULL FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part) UNION ALL SELECT 4, 'ALL_NAMES', p_name FROM part WHERE p_retailprice > 0
  UNION ALL SELECT 5, 'ECONOMY', p_name || p_type FROM part WHERE p_type = 'ECONOMY')"""


@query("q23_condition_status", f"""
WITH {_COND}, d AS (SELECT position, condition, count(DISTINCT feature) AS feature_count, sha256(coalesce(string_agg(DISTINCT feature, chr(10) ORDER BY feature), '') || chr(10)) AS digest FROM members GROUP BY position, condition),
a AS (SELECT *, CASE WHEN feature_count = 0 THEN NULL WHEN bool_or(condition = 'FULL') OVER (PARTITION BY digest) THEN 'FULL' ELSE first_value(condition) OVER (PARTITION BY digest ORDER BY position) END AS first FROM d)
SELECT condition, feature_count, digest, CASE WHEN feature_count = 0 THEN 'EMPTY' WHEN condition = 'FULL' THEN 'REFERENCE' WHEN first <> condition THEN 'ALIAS' ELSE 'UNIQUE' END AS status,
  CASE WHEN first <> condition THEN first END AS alias_of FROM a""")
def q23(spark, sf):
    p = table(spark, sf, "part")

    def part(i, name, rows, feature=F.col("p_name")):
        return rows.select(F.lit(i).alias("position"), F.lit(name).alias("condition"), feature.alias("feature"))

    first_key = p.agg(F.min("p_partkey")).scalar()
    parts = [
        part(0, "FULL", p), part(1, "SMALL", p.where("p_size < 10")), part(2, "SMALL_AGAIN", p.where("p_size <= 9")),
        part(3, "EMPTY", p.where(F.col("p_partkey") == first_key), F.lit(None).cast("string")), part(4, "ALL_NAMES", p.where("p_retailprice > 0")),
        part(5, "ECONOMY", p.where("p_type = 'ECONOMY'"), F.concat("p_name", "p_type")),
    ]
    from cohortloom.operators.tables import concat_unlike

    return audit.condition_status(concat_unlike(parts), "position", "condition", "feature", "FULL")
