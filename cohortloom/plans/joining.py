"""Joins (J01-J12)."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import joins

from .inputs import SAMPLES, VECTORS, r, samples, table, vectors
from .registry import query


@query("j01_align_outcomes", f"""
WITH {SAMPLES}, f AS (SELECT subject, stream, round(avg(value), 8) AS mean_value FROM samples GROUP BY subject, stream),
p AS (SELECT subject, stream, max(k) AS max_k FROM samples WHERE k > 50 GROUP BY subject, stream)
SELECT f.subject, f.stream, mean_value, max_k FROM f JOIN p ON f.subject = p.subject AND f.stream = p.stream""")
def j01(spark, sf):
    s = samples(spark, sf)
    f = s.groupBy("subject", "stream").agg(r(F.avg("value")).alias("mean_value"))
    p = s.where("k > 50").groupBy("subject", "stream").agg(F.max("k").alias("max_k"))
    return f.join(p, ["subject", "stream"])


@query("j02_validated_join", "SELECT o_custkey AS custkey, o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j02(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return joins.join_validated(o, c, ["custkey"], "many_to_one")


@query("j02_one_to_one", "SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j02_one(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return joins.join_validated(d, table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


@query("j03_reconcile", """
WITH a AS (SELECT doc_id, n_chars % 2 AS quality, 0 AS toxic FROM documents WHERE n_chars > 500),
b AS (SELECT doc_id, quality, toxic FROM labels)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left_only' WHEN a.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side,
  a.quality IS NOT DISTINCT FROM b.quality AS quality_equal, a.toxic IS NOT DISTINCT FROM b.toxic AS toxic_equal
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def j03(spark, sf):
    d = table(spark, sf, "documents").where("n_chars > 500")
    a = d.select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return joins.reconcile(a, table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"])


@query("j04_known_rows", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j04(spark, sf):
    return joins.keep_known(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@query("j05_holdout_rows", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j05(spark, sf):
    return joins.keep_unknown(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@query("j06_coverage_gap", f"""
WITH {SAMPLES}, a AS (SELECT DISTINCT subject, stream FROM samples WHERE value > 120),
g AS (SELECT u.subject, p.stream FROM (SELECT DISTINCT subject FROM a) u CROSS JOIN (SELECT DISTINCT stream FROM a) p)
SELECT g.subject, g.stream, 'missing' AS status FROM g LEFT JOIN a ON a.subject = g.subject AND a.stream = g.stream WHERE a.subject IS NULL""")
def j06(spark, sf):
    return joins.coverage_gap(samples(spark, sf).where("value > 120"), "subject", "stream")


@query("j07_paired_conditions", f"""
WITH {SAMPLES}, m AS (SELECT subject, stream, round(avg(value), 8) AS v FROM samples GROUP BY subject, stream)
SELECT a.subject, a.v AS left_value, b.v AS right_value FROM m a JOIN m b ON a.subject = b.subject WHERE a.stream = 'click' AND b.stream = 'error'""")
def j07(spark, sf):
    m = samples(spark, sf).groupBy("subject", "stream").agg(r(F.avg("value")).alias("v"))
    return joins.paired(m, ["subject"], "stream", "click", "error", "v")


@query("j08_fold_dimension", f"""
WITH {SAMPLES}, folds AS (SELECT DISTINCT subject, subject % 5 + 1 AS outer_fold FROM samples)
SELECT outer_fold, count(*) AS n, count(DISTINCT s.subject) AS subjects FROM samples s JOIN folds f ON s.subject = f.subject GROUP BY outer_fold""")
def j08(spark, sf):
    s = samples(spark, sf)
    folds = s.select("subject", (F.col("subject") % 5 + 1).alias("outer_fold")).distinct()
    per = s.join(folds, "subject").groupBy("outer_fold", "subject").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("outer_fold").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("subjects"))


def _knn_sql(p: int, k: int) -> str:
    term = "sum(abs(a.x - b.x))" if p == 1 else "sqrt(sum((a.x - b.x) * (a.x - b.x)))"
    return f"""{VECTORS}, el AS (SELECT vec_id, target_class, unnest(vec) AS x, unnest(range(64)) AS j FROM vectors),
d AS (SELECT a.vec_id, b.vec_id AS neighbor, any_value(b.target_class) AS lab, round({term}, 9) AS distance
  FROM el a JOIN el b ON a.j = b.j AND a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY a.vec_id, b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS nth FROM d QUALIFY nth <= {k})"""


def _split(spark, sf):
    v = vectors(spark, sf).select("vec_id", "vec", "target_class")
    return v.where("vec_id % 5 = 0"), v.where("vec_id % 5 <> 0")


@query("j10_knn_neighbors", f"WITH {_knn_sql(2, 5)} SELECT vec_id, nth, neighbor, round(distance, 6) AS distance FROM nn")
def j10(spark, sf):
    test, train = _split(spark, sf)
    n = joins.knn_join(test, train, "vec_id", "vec", "target_class", 5)
    return n.select("vec_id", F.col("nth").cast("long").alias("nth"), "neighbor", r("distance", 6).alias("distance"))


@query("j10_knn_neighbors_manhattan", f"WITH {_knn_sql(1, 3)} SELECT vec_id, nth, neighbor, round(distance, 6) AS distance FROM nn")
def j10_p1(spark, sf):
    test, train = _split(spark, sf)
    n = joins.knn_join(test, train, "vec_id", "vec", "target_class", 3, p=1)
    return n.select("vec_id", F.col("nth").cast("long").alias("nth"), "neighbor", r("distance", 6).alias("distance"))


def _vote_sql(weight: str) -> str:
    return f"""votes AS (SELECT vec_id, lab, {weight} AS w FROM nn GROUP BY vec_id, lab),
best AS (SELECT vec_id, lab FROM votes QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, lab) = 1)"""


@query("m05_knn_uniform", f"WITH {_knn_sql(2, 7)}, {_vote_sql('count(*)')} SELECT vec_id, lab AS prediction FROM best")
def m05(spark, sf):
    test, train = _split(spark, sf)
    return joins.knn_vote(joins.knn_join(test, train, "vec_id", "vec", "target_class", 7), "vec_id", 7)


@query("m05_knn_distance", f"WITH {_knn_sql(2, 7)}, {_vote_sql('round(sum(1 / greatest(distance, 1e-12)), 6)')} SELECT vec_id, lab AS prediction FROM best")
def m05_distance(spark, sf):
    test, train = _split(spark, sf)
    return joins.knn_vote(joins.knn_join(test, train, "vec_id", "vec", "target_class", 7), "vec_id", 7, "distance")


_ASOF = f"""{SAMPLES}, l AS (SELECT * FROM samples WHERE stream = 'click'),
rr AS (SELECT subject, t, max_by(value, event_id) AS value FROM samples WHERE stream = 'error' GROUP BY subject, t)"""


@query("j11_asof_align", f"""
WITH {_ASOF} SELECT l.event_id, l.subject, CASE WHEN l.t - rr.t <= 43200 THEN rr.value END AS right_value
FROM l ASOF LEFT JOIN rr ON l.subject = rr.subject AND l.t >= rr.t""")
def j11(spark, sf):
    s = samples(spark, sf)
    left = s.where("stream = 'click'").select("event_id", "subject", "t")
    right = s.where("stream = 'error'").select("event_id", "subject", "t", "value")
    a = joins.asof_align(left, right, ["subject"], "t", ["value"], "event_id", 43200.0)
    return a.select("event_id", "subject", "right_value")


@query("j12_excerpt_by_index", f"""
WITH {SAMPLES} SELECT subject, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t, event_id) AS rn FROM samples) WHERE rn > 3 AND rn <= 7""")
def j12(spark, sf):
    e = joins.excerpt_by_index(samples(spark, sf), ["subject"], ["t", "event_id"], 3, 7)
    return e.select("subject", "event_id", "value")


@query("j12_excerpt_by_time", f"WITH {SAMPLES} SELECT subject, event_id, value FROM samples WHERE t >= 1704672000 AND t < 1705276800")
def j12_time(spark, sf):
    return joins.excerpt_by_time(samples(spark, sf), "t", 1704672000.0, 1705276800.0).select("subject", "event_id", "value")
