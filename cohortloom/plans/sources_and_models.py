"""Scans and sinks (A01-A09) and classical models."""
from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortloom import session
from cohortloom.functions.numeric import argmax_low, bound
from cohortloom.operators import boosting, forest, linear, metrics, models, tables
from cohortloom.sources import files, sinks, versions
from cohortloom.sources.tables import read_table

from .inputs import FEATURES, SAMPLES, VECTORS, features, r, samples, table, vectors
from .preparation import folded
from .registry import query


def _folder(spark, name: str) -> str:
    return f"{session.checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- scans and sinks ---------------------------------------------------------------------------


def _stream_files(spark, sf) -> str:
    """The events as CSV files in one folder per stream and subject group."""
    root = _folder(spark, "streams")
    s = samples(spark, sf).withColumn("sub", F.format_string("cp%03d", F.col("subject") % 8))
    bad = F.when(F.col("event_id") % 19 == 0, "n/a").otherwise(F.col("value").cast("string"))
    rows = s.select("stream", "sub", F.col("t").alias("time_dn"), "event_id", bad.alias("signal_mV"), F.col("k").alias("level"))
    rows.write.partitionBy("stream", "sub").option("header", "true").csv(root)
    return root


@query("a01_read_streams", f"""
WITH {SAMPLES}, l AS (SELECT printf('cp%03d', subject % 8) AS subject_id, stream, t, 'event_id' AS "column", CAST(event_id AS DOUBLE) AS value FROM samples
  UNION ALL SELECT printf('cp%03d', subject % 8), stream, t, 'signal_mV', CASE WHEN event_id % 19 <> 0 THEN value END FROM samples
  UNION ALL SELECT printf('cp%03d', subject % 8), stream, t, 'level', CAST(k AS DOUBLE) FROM samples)
SELECT * FROM l""")
def a01(spark, sf):
    root = _stream_files(spark, sf)
    columns = ["time_dn", "event_id", "signal_mV", "level"]
    layouts = {s: (f"{root}/stream={s}", columns) for s in ("click", "error", "purchase", "signup", "view")}
    return files.read_streams(spark, layouts, "time_dn", {"subject_id": F.regexp_extract("path", "sub=([^/]+)", 1)})


@query("a02_file_inventory")
def a02(spark, sf):
    return files.file_inventory(spark, sf, "*.parquet").select("file_name", "extension", "folder", "bytes", "modified")


@query("a03_inventory_summary", """
SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes, round(sum(n_chars) / 1048576, 8) AS mib FROM documents GROUP BY source ORDER BY bytes DESC, source LIMIT 15""")
def a03(spark, sf):
    return files.inventory_summary(table(spark, sf, "documents"), "source", "n_chars").withColumn("mib", r("mib"))


@query("a04_json_manifest", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def a04(spark, sf):
    path = _folder(spark, "manifest")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size").write.json(path)
    return spark.read.schema("p_partkey long, p_name string, p_brand string, p_size int").json(path)


@query("a05_column_subset", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 25")
def a05(spark, sf):
    return read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 25")


@query("a06_write_table", f"WITH {SAMPLES} SELECT event_id, value, stream FROM samples")
def a06(spark, sf):
    path = _folder(spark, "table")
    s = samples(spark, sf).select("event_id", "value", "stream")
    versions.publish(s.withColumn("value", -F.col("value")), path)  # replaced by the next one
    versions.publish(s, path, ["event_id"], ["stream"])
    return versions.read(spark, path)


@query("a06_versions", f"""
WITH {SAMPLES} SELECT CAST(v AS BIGINT) AS version, count(*) AS rows, round(sum(value) * v, 4) + 0.0 AS total FROM samples, (SELECT unnest([1, 2]) AS v) GROUP BY v""")
def a06_versions(spark, sf):
    """Every published version stays readable under its number, with the rows its manifest names."""
    path = _folder(spark, "versions")
    s = samples(spark, sf).select("event_id", "value", "stream")
    first, second = versions.publish(s, path), versions.publish(s.withColumn("value", 2 * F.col("value")), path)
    totals = [versions.read(spark, path, v).agg(r(F.sum("value"), 4).alias("total")).withColumn("version", F.lit(v).cast("long")) for v in (first, second)]
    return versions.history(spark, path).select("version", "rows").join(totals[0].unionByName(totals[1]), "version")


WIDE = [f"f{i:02d}" for i in range(64)]


@query("a07_export_wide", f"""
WITH {VECTORS} SELECT vec_id, round(vec[1], 6) AS f00, round(vec[32], 6) AS f31, round(vec[64], 6) AS f63 FROM vectors""")
def a07(spark, sf):
    path = _folder(spark, "wide")
    sinks.export_wide(features(spark, sf), ["vec_id"], "feature", "value", WIDE, path)
    wide = spark.read.option("header", "true").csv(path)
    return wide.select(F.col("vec_id").cast("long").alias("vec_id"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("f00", "f31", "f63")])


@query("a08_write_frozen", """
SELECT * FROM (SELECT 'CREATED' AS first_write, 'REUSED' AS second_write, 'REFUSED' AS changed_write), (SELECT count(*) AS rows FROM orders)""")
def a08(spark, sf):
    path = _folder(spark, "frozen")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    first, second = versions.publish_once(o, path), versions.publish_once(o.orderBy(F.col("o_orderkey").desc()), path)
    try:
        third = versions.publish_once(o.withColumn("o_orderstatus", F.lit("X")), path)
    except ValueError:
        third = "REFUSED"
    count = versions.read(spark, path).agg(F.count(F.lit(1)).alias("rows"))
    return count.select(F.lit(first).alias("first_write"), F.lit(second).alias("second_write"), F.lit(third).alias("changed_write"), "rows")


@query("a09_pending_units", """
SELECT o_orderkey, sha256(o_orderstatus) AS digest FROM orders m WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderkey = m.o_orderkey AND d.o_totalprice < 300000 AND d.o_orderstatus <> 'P')""")
def a09(spark, sf):
    o = table(spark, sf, "orders")
    manifest = o.select("o_orderkey", F.sha2("o_orderstatus", 256).alias("digest"))
    stale = F.when(F.col("o_orderstatus") == "P", "old").otherwise(F.col("o_orderstatus"))
    done = o.where("o_totalprice < 300000").select("o_orderkey", F.sha2(stale, 256).alias("digest"))
    return tables.pending_units(manifest, done, ["o_orderkey"], "digest")


# --- models ------------------------------------------------------------------------------------

TRAIN = "subject % 5 <> 0"


def _data(spark, sf, label):
    v = models.frame(vectors(spark, sf), "vec", label)
    return v, v.where(TRAIN)


def _classified(model, df):
    return model.transform(df).select("vec_id", "target_class", F.col("prediction").cast("int").alias("prediction"))


@query("m01_dummy_baselines", f"""
WITH {VECTORS}, tr AS (SELECT * FROM vectors WHERE {TRAIN}), c AS (SELECT target_class AS k, count(*) AS n FROM tr GROUP BY target_class),
cum AS (SELECT k, n, sum(n) OVER (ORDER BY k) AS upto, sum(n) OVER () AS total FROM c), u AS (SELECT vec_id, ('0x' || substr(md5('dummy|' || vec_id), 1, 8))::BIGINT AS u FROM vectors)
SELECT vec_id, (SELECT arg_max(k, n * 1000 - k) FROM c) AS most_frequent, (SELECT min(k) FROM cum WHERE u % total < upto) AS stratified,
  round((SELECT avg(target_score) FROM tr), 8) AS mean_score, (SELECT quantile_cont(target_score, 0.5) FROM tr) AS median_score FROM u""")
def m01(spark, sf):
    d = models.dummy(vectors(spark, sf), F.expr(TRAIN), "target_class", "target_score", "vec_id", [0, 1, 2, 3])
    return d.withColumn("mean_score", r("mean_score"))


@query("m02_logistic_regression")
def m02(spark, sf):
    v, train = _data(spark, sf, "target_class")
    return _classified(models.logistic(train, 10.0), v)


@query("m03_linear_svm")
def m03(spark, sf):
    v = vectors(spark, sf)
    machines = linear.squared_hinge(v.where(TRAIN), "vec", "target_class", 4, 10.0)
    return v.select("vec_id", "target_class", argmax_low(linear.values("vec", machines)).alias("prediction"))


PENALTIES = [0.1, 1.0, 10.0]


@query("m03_svm_certificate", """
SELECT c, class, true AS certified FROM (SELECT unnest([0.1::DOUBLE, 1, 10]) AS c), (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS class)""")
def m03_certificate(spark, sf):
    """Whether the duality gap is below 1e-4 of the objective for every published penalty and class."""
    v = vectors(spark, sf).where(TRAIN)
    machines = linear.fit(v, "vec", "target_class", [linear.Machine(c, positive=k) for c in PENALTIES for k in range(4)])
    found = [(m.c, m.positive, -1e-9 <= m.gap < 1e-4) for m in machines]
    return spark.createDataFrame(found, "c double, class int, certified boolean")


@query("m04_random_forest_classifier")
def m04(spark, sf):
    found = forest.predictions(vectors(spark, sf), F.expr(TRAIN), "vec", "target_class", 4, trees=200, depth=20)
    return found.select("vec_id", "target_class", F.col("prediction").cast("int").alias("prediction"))


@query("m04_random_forest_regressor")
def m04_reg(spark, sf):
    found = forest.predictions(vectors(spark, sf), F.expr(TRAIN), "vec", "target_score", None, trees=200, depth=20)
    return models.regression_output(found, ["vec_id", "target_score"])


@query("m06_boosted_classifier")
def m06(spark, sf):
    v = vectors(spark, sf)
    booster = boosting.boost(v.where(TRAIN), "vec", "target_class", 4, rounds=100)
    return v.select("vec_id", "target_class", argmax_low(booster.predict(v, "vec")).alias("prediction"))


@query("m06_boosted_regressor")
def m06_reg(spark, sf):
    v = vectors(spark, sf)
    booster = boosting.boost(v.where(TRAIN), "vec", "target_score", None, rounds=100)
    raw = v.withColumn("prediction_raw", booster.predict(v, "vec"))
    return raw.select("vec_id", "target_score", "prediction_raw", bound(F.col("prediction_raw"), 1.0, 4.0).alias("prediction_bounded"))


@query("m06_first_splits", f"""
WITH {FEATURES}, tr AS (SELECT * FROM features WHERE {TRAIN}), n AS (SELECT count(*) AS n FROM tr WHERE pos = 0),
c AS (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS class), prior AS (SELECT class, count(*) FILTER (target_class = class) / any_value(n.n) AS p FROM tr, c, n WHERE pos = 0 GROUP BY class),
cuts AS (SELECT DISTINCT pos, unnest(quantile_cont(value, [i / 32 FOR i IN range(1, 32)])) AS cut FROM tr GROUP BY pos),
s AS (SELECT class, t.pos, cut, any_value(n.n) AS n, any_value(p) AS p, count(*) FILTER (value <= cut) AS nl, count(*) FILTER (value <= cut AND target_class = class) AS kl, count(*) FILTER (target_class = class) AS k
  FROM tr t JOIN cuts ON t.pos = cuts.pos, prior, n GROUP BY class, t.pos, cut),
g AS (SELECT *, nl * (n - nl) / n * ((kl - p * nl) / nl - ((k - kl) - p * (n - nl)) / (n - nl)) ** 2 AS gain FROM s WHERE nl > 0 AND nl < n)
SELECT class, CAST(pos AS INTEGER) AS pos, round(cut, 7) AS cut, nl AS left_rows, round(gain, 6) AS gain FROM g QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(gain, 9) DESC, pos, cut) = 1""")
def m06_splits(spark, sf):
    found = boosting.first_splits(vectors(spark, sf).where(TRAIN), "vec", "target_class", 4)
    out = spark.createDataFrame(found, "class int, pos int, cut double, left_rows long, gain double")
    return out.select("class", "pos", r("cut", 7).alias("cut"), "left_rows", r("gain", 6).alias("gain"))


@query("m07_ridge")
def m07(spark, sf):
    v, train = _data(spark, sf, "target_score")
    return models.regression_output(models.ridge(train, 1.0, 64).transform(v), ["vec_id", "target_score"])


@query("m08_elastic_net")
def m08(spark, sf):
    v, train = _data(spark, sf, "target_score")
    return models.regression_output(models.elastic_net(train, 0.001, 0.5, 64).transform(v), ["vec_id", "target_score"])


@query("m09_linear_svr")
def m09(spark, sf):
    v = vectors(spark, sf)
    machine = linear.insensitive(v.where(TRAIN), "vec", "target_score", c=1.0, epsilon=0.1)
    predicted = F.get(linear.values("vec", [machine]), F.lit(0))
    return models.regression_output(v.withColumn("prediction", predicted), ["vec_id", "target_score"])


@query("m09_svr_certificate", """
SELECT c, epsilon, true AS certified FROM (SELECT unnest([0.01::DOUBLE, 0.1, 1, 10]) AS c), (SELECT unnest([0.0::DOUBLE, 0.1, 0.2]) AS epsilon)""")
def m09_certificate(spark, sf):
    """Whether the duality gap is below 1e-4 of the objective for every published candidate."""
    machines = [linear.Machine(c, epsilon=e) for c in (0.01, 0.1, 1.0, 10.0) for e in (0.0, 0.1, 0.2)]
    linear.fit(vectors(spark, sf).where(TRAIN), "vec", "target_score", machines)
    found = [(m.c, m.epsilon, -1e-9 <= m.gap < 1e-4) for m in machines]
    return spark.createDataFrame(found, "c double, epsilon double, certified boolean")


@query("m10_least_squares_on_components")
def m10(spark, sf):
    v, train = _data(spark, sf, "target_score")
    return models.regression_output(models.least_squares_on_components(train).transform(v), ["vec_id", "target_score"])


@query("m11_svm_roc")
def m11(spark, sf):
    v = models.frame(vectors(spark, sf).withColumn("hard", (F.col("target_class") >= 2).cast("int")), "vec", "hard")
    scored = models.binary_svm(v.where(TRAIN), 1.0).transform(v)
    s = scored.select(F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("score"), "hard")
    return metrics.roc_points(s, "score", F.col("hard") == 1).select("threshold", "tpr", "fpr")


@query("m12_nested_pipeline")
def m12(spark, sf):
    found = models.nested_predictions(folded(spark, sf), "fold", 5, "target_class", "target_score", "vec_id", 20, lambda t: models.logistic(t, 1.0))
    return found.withColumn("y_pred", F.col("y_pred").cast("int"))
