"""Subject-level statistics."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import metrics, stats, tables

from .inputs import PREDICTIONS, predictions, r, table
from .metric_queries import OOF, STREAMS, class_sql, oof
from .registry import query

SUBJ = """subj AS (SELECT model, condition, subject, round(avg(abs(target_score - y_pred_bounded)), 6) AS mae FROM oof GROUP BY model, condition, subject)"""


def subject_mae(spark, sf):
    o = oof(spark, sf)
    return o.groupBy("model", "condition", "subject").agg(r(F.avg(F.abs(F.col("target_score") - F.col("y_pred_bounded"))), 6).alias("mae"))


OTHERS = [s for s in STREAMS if s != "view"]
DEG = f"""{SUBJ}, deg AS (SELECT a.model, a.condition, a.subject, b.mae AS reference_value, a.mae AS condition_value, a.mae - b.mae AS degradation
  FROM subj a JOIN subj b ON a.model = b.model AND a.subject = b.subject AND b.condition = 'view' WHERE a.condition <> 'view')"""


def degraded(spark, sf):
    return stats.degradation(subject_mae(spark, sf), ["model", "subject"], "condition", "view", "mae", OTHERS, higher_is_better=False)


SIGNED = """nz AS (SELECT model, condition, round(degradation, 6) AS d FROM deg WHERE abs(round(degradation, 6)) > 1e-12),
rk AS (SELECT *, rank() OVER (PARTITION BY model, condition ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, condition, abs(d)) - 1) / 2.0::DOUBLE AS rnk FROM nz),
w AS (SELECT model, condition, count(*) AS n, sum(CASE WHEN d > 0 THEN rnk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rnk ELSE 0 END) AS wm FROM rk GROUP BY model, condition)"""


def _deg6(spark, sf):
    return degraded(spark, sf).withColumn("degradation", r("degradation", 6))


@query("n01_wilcoxon_statistic", f"WITH {OOF}, {DEG}, {SIGNED} SELECT model, condition, n, round(least(wp, wm), 4) AS statistic FROM w")
def n01(spark, sf):
    w = stats.wilcoxon(_deg6(spark, sf), ["model", "condition"], "degradation")
    return w.select("model", "condition", "n", r("statistic", 4).alias("statistic"))


@query("n01_wilcoxon_p_value")
def n01_p(spark, sf):
    return stats.wilcoxon(_deg6(spark, sf), ["model", "condition"], "degradation")


FRIED = """cells AS (SELECT model, subject, condition, mae, rank() OVER w + (count(*) OVER (PARTITION BY model, subject, mae) - 1) / 2.0::DOUBLE AS rnk, count(*) OVER (PARTITION BY model, subject, mae) AS t FROM subj WINDOW w AS (PARTITION BY model, subject ORDER BY mae)),
cols AS (SELECT model, condition, sum(rnk) AS s FROM cells GROUP BY model, condition), n AS (SELECT model, count(DISTINCT subject) AS n, sum(t * t - 1) AS ties FROM cells GROUP BY model),
fr AS (SELECT c.model, any_value(n) AS subjects, (12.0::DOUBLE / (any_value(n) * 30) * sum(s * s) - 3 * any_value(n) * 6) / (1 - any_value(ties) / (any_value(n) * 5 * 24.0::DOUBLE)) AS statistic FROM cols c JOIN n ON c.model = n.model GROUP BY c.model)"""


@query("n02_friedman", f"WITH {OOF}, {SUBJ}, {FRIED} SELECT model, subjects, round(statistic, 6) + 0.0 AS statistic, 'PASS' AS status FROM fr")
def n02(spark, sf):
    f = stats.friedman(subject_mae(spark, sf), ["model"], "subject", "condition", "mae", STREAMS)
    return f.withColumn("statistic", r("statistic", 6))


# Four degrees of freedom: the upper tail is exp(-x/2) (1 + x/2).
@query("n02_friedman_p_value", f"WITH {OOF}, {SUBJ}, {FRIED} SELECT model, round(exp(-statistic / 2) * (1 + statistic / 2), 8) AS p_value FROM fr")
def n02_p(spark, sf):
    f = stats.friedman(subject_mae(spark, sf), ["model"], "subject", "condition", "mae", STREAMS)
    return stats.friedman_p(f, 5).select("model", r("p_value").alias("p_value"))


@query("n03_rank_biserial", f"WITH {OOF}, {DEG}, {SIGNED} SELECT model, condition, round((wp - wm) / (wp + wm), 8) + 0.0 AS effect FROM w")
def n03(spark, sf):
    s = stats.signed_ranks(_deg6(spark, sf), ["model", "condition"], "degradation")
    return s.select("model", "condition", r(stats.rank_biserial()).alias("effect"))


@query("n04_holm", """
WITH t AS (SELECT o_orderpriority AS family, o_orderstatus || '|' || CAST(year(o_orderdate) AS VARCHAR) AS test, round(1 / (1 + abs(avg(o_totalprice) - 250000) / 1000), 9) AS p FROM orders GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS rn FROM t)
SELECT family, test, p, round(least(1, max(p * (m - rn + 1)) OVER (PARTITION BY family ORDER BY rn)), 8) AS p_holm FROM k""")
def n04(spark, sf):
    o = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("family"), F.concat_ws("|", "o_orderstatus", F.year("o_orderdate").cast("string")).alias("test")
    ).agg(F.round(1 / (1 + F.abs(F.avg("o_totalprice") - 250000) / 1000), 9).alias("p"))
    return stats.holm(o, ["family"], "p", "test").withColumn("p_holm", r("p_holm"))


@query("n05_pareto_front", """
SELECT p_brand, p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand
  AND b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))""")
def n05(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return tables.pareto_front(p, ["p_brand"], "p_retailprice", "p_size")


@query("j09_pareto_dominance_3d", """
WITH c AS (SELECT o_orderpriority AS task, o_orderkey, o_custkey AS runtime, o_totalprice AS perf, year(o_orderdate)::BIGINT AS bytes FROM orders)
SELECT task, o_orderkey, runtime, perf, bytes FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.task = a.task AND b.runtime <= a.runtime AND b.perf >= a.perf AND b.bytes <= a.bytes
  AND (b.runtime < a.runtime OR b.perf > a.perf OR b.bytes < a.bytes))""")
def j09(spark, sf):
    o = table(spark, sf, "orders")
    c = o.select(
        F.col("o_orderpriority").alias("task"), "o_orderkey", F.col("o_custkey").alias("runtime"), F.col("o_totalprice").alias("perf"), F.year("o_orderdate").cast("long").alias("bytes")
    )
    return tables.pareto_front(c, ["task"], "runtime", "perf", "bytes")


def _boot_sql(reps: int, src: str, keys: str, unit: str, value: str, salt: str) -> str:
    return f"""num AS (SELECT {keys}, {unit}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {unit}) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}),
draws AS (SELECT {keys}, rep, ('0x' || substr(md5('{salt}|' || rep || '|' || i), 1, 8))::BIGINT % n AS i FROM num, (SELECT unnest(range(1, {reps + 1})) AS rep)),
est AS (SELECT {', '.join('d.' + k.strip() for k in keys.split(','))}, rep, avg(v) AS e FROM draws d JOIN num u ON d.i = u.i AND {' AND '.join(f'd.{k.strip()} = u.{k.strip()}' for k in keys.split(','))} GROUP BY ALL)"""


@query("n06_bootstrap_ci", f"""
WITH {OOF}, {DEG}, {_boot_sql(2000, 'deg', 'model, condition', 'subject', 'degradation', 'boot')},
q AS (SELECT model, condition, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi FROM est GROUP BY model, condition),
p AS (SELECT model, condition, avg(degradation) AS m, count(*) AS units FROM deg GROUP BY model, condition)
SELECT p.model, p.condition, units, round(m, 7) + 0.0 AS estimate, round(lo, 7) + 0.0 AS ci_low, round(hi, 7) + 0.0 AS ci_high FROM p JOIN q ON p.model = q.model AND p.condition = q.condition""")
def n06(spark, sf):
    b = stats.bootstrap_ci(degraded(spark, sf), ["model", "condition"], "subject", "degradation")
    return b.select("model", "condition", "units", *[r(c, 7).alias(c) for c in ("estimate", "ci_low", "ci_high")])


_STATS = ", ".join(f"count(CASE WHEN y_true = {k} AND y_pred = {k} THEN 1 END) AS tp{k}, count(CASE WHEN y_true = {k} THEN 1 END) AS sup{k}, count(CASE WHEN y_pred = {k} THEN 1 END) AS pos{k}" for k in range(4))
_F1 = "(" + " + ".join(f"CASE WHEN sum(w * sup{k}) + sum(w * pos{k}) > 0 THEN 2 * sum(w * tp{k}) / (sum(w * sup{k}) + sum(w * pos{k})) ELSE 0 END" for k in range(4)) + ") / 4"


@query("n07_cluster_bootstrap", f"""
WITH {OOF}, ss AS (SELECT model, subject, {_STATS} FROM oof GROUP BY model, subject), u AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM oof)),
dr AS (SELECT rep, ('0x' || substr(md5('cluster|' || rep || '|' || i), 1, 8))::BIGINT % n AS i FROM u, (SELECT unnest(range(1, 501)) AS rep)),
wt AS (SELECT rep, subject, count(*) AS w FROM dr JOIN u ON dr.i = u.i GROUP BY rep, subject),
e AS (SELECT model, rep, {_F1} AS f1 FROM ss JOIN wt ON ss.subject = wt.subject GROUP BY model, rep),
q AS (SELECT model, quantile_cont(f1, 0.025) AS lo, quantile_cont(f1, 0.975) AS hi FROM e GROUP BY model), p AS (SELECT model, {_F1} AS f1 FROM (SELECT *, 1 AS w FROM ss) GROUP BY model)
SELECT p.model, round(f1, 7) AS estimate, round(lo, 7) AS ci_low, round(hi, 7) AS ci_high FROM p JOIN q ON p.model = q.model""")
def n07(spark, sf):
    c = stats.cluster_bootstrap(oof(spark, sf), ["model"], "subject", "macro_f1", reps=500)
    return c.select("model", *[r(x, 7).alias(x) for x in ("estimate", "ci_low", "ci_high")])


@query("n08_degradation", f"""
WITH {OOF}, {DEG} SELECT model, condition, count(*) AS subjects, round(avg(degradation), 7) + 0.0 AS mean_degradation, round(quantile_cont(degradation, 0.5), 7) + 0.0 AS median_degradation,
  round(avg(degradation) / abs(avg(reference_value)) * 100, 5) + 0.0 AS relative_percent, CASE WHEN avg(degradation) > 0 THEN 'DECREASE' ELSE 'IMPROVEMENT_OR_NO_DECREASE' END AS direction FROM deg GROUP BY model, condition""")
def n08(spark, sf):
    s = stats.degradation_summary(degraded(spark, sf), ["model", "condition"])
    return s.select("model", "condition", "subjects", r("mean_degradation", 7).alias("mean_degradation"), r("median_degradation", 7).alias("median_degradation"), r("relative_percent", 5).alias("relative_percent"), "direction")


@query("n09_rank_conditions", f"""
WITH {OOF}, m AS (SELECT model, condition, macro_f1 FROM ({class_sql('oof', 'model, condition')}))
SELECT a.model, a.condition, a.macro_f1, rank() OVER (PARTITION BY a.model ORDER BY a.macro_f1 DESC) AS rank, round(a.macro_f1 - b.macro_f1, 7) + 0.0 AS delta_to_reference
FROM m a JOIN m b ON a.model = b.model AND b.condition = 'view' WHERE a.condition <> 'view'""")
def n09(spark, sf):
    m = metrics.classification_metrics(oof(spark, sf), ["model", "condition"]).select("model", "condition", r("macro_f1").alias("macro_f1"))
    k = stats.rank_conditions(m, ["model"], "condition", "macro_f1", "view")
    return k.select("model", "condition", "macro_f1", F.col("rank").cast("long").alias("rank"), r("delta_to_reference", 7).alias("delta_to_reference"))


@query("n10_model_contrast", f"""
WITH {OOF}, {SUBJ}, c AS (SELECT a.condition, a.mae AS l, b.mae AS rr FROM subj a JOIN subj b ON a.condition = b.condition AND a.subject = b.subject AND a.model = 'HDC' AND b.model = 'TRADITIONAL')
SELECT condition, count(*) AS subjects, round(avg(l), 7) AS left_mean, round(avg(rr), 7) AS right_mean, round(avg(l - rr), 7) + 0.0 AS mean_difference, CASE WHEN avg(l) < avg(rr) THEN 'HDC' ELSE 'TRADITIONAL' END AS lower FROM c GROUP BY condition""")
def n10(spark, sf):
    c = stats.contrast(subject_mae(spark, sf), ["condition"], "subject", "model", "mae", "HDC", "TRADITIONAL")
    return c.select("condition", "subjects", *[r(x, 7).alias(x) for x in ("left_mean", "right_mean", "mean_difference")], "lower")


@query("n11_comparison_table", f"""
WITH {PREDICTIONS}, m AS (SELECT model, condition, macro_f1 FROM ({class_sql('predictions', 'model, condition, seed')}))
SELECT model, condition, count(*) AS repeats, printf('%.4f', round(avg(macro_f1), 4)) || ' ± ' || printf('%.4f', round(stddev_samp(macro_f1), 4)) AS summary FROM m GROUP BY model, condition""")
def n11(spark, sf):
    m = metrics.classification_metrics(predictions(spark, sf), ["model", "condition", "seed"]).withColumn("macro_f1", r("macro_f1"))
    return stats.comparison_table(m, ["model", "condition"], "macro_f1")
