"""Study-shaped views (samples, features, predictions) over the given tables, with SQL twins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.sources.tables import read_table

SEEDS = [42, 43, 44, 45, 46]
DECIMALS = 8


def r(c: Column | str, digits: int = DECIMALS) -> Column:
    """Rounded double without a negative zero, so two engines print the same value."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_table(spark, f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sample: subject = user, stream = event type, run = both."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("subject"),
        F.col("event_type").alias("stream"),
        F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("run_key"),
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


SAMPLES = """samples AS (
  SELECT user_id AS subject, event_type AS stream, user_id || '_' || event_type AS run_key, event_id,
         epoch_us(ts) / 1e6 AS t, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One row per vector with study roles: subject, class 0-3, score 1-4."""
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id",
        (F.col("vec_id") % 35).alias("subject"),
        (F.col("label") % 4).alias("target_class"),
        (F.col("label") % 4 + 1).cast("double").alias("target_score"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
    )


VECTORS = """vectors AS (
  SELECT vec_id, vec_id % 35 AS subject, label % 4 AS target_class, CAST(label % 4 + 1 AS DOUBLE) AS target_score,
         CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""


def features(spark: SparkSession, sf: str, missing: bool = False) -> DataFrame:
    """Long feature table (vec_id, feature position, value); ``missing`` blanks every 17th cell."""
    long = vectors(spark, sf).select(
        "vec_id", "subject", "target_class", "target_score", F.posexplode("vec").alias("pos", "value")
    )
    long = long.withColumn("feature", F.format_string("f%02d", F.col("pos")))
    if missing:
        gone = (F.col("pos") < 8) & (F.pmod(F.col("vec_id") * 7 + F.col("pos"), F.lit(17)) == 0)
        long = long.withColumn("value", F.when(~gone, F.col("value")))
    return long


FEATURES = (
    VECTORS
    + """, positions AS (SELECT unnest(range(64)) AS pos),
features AS (
  SELECT vec_id, subject, target_class, target_score, CAST(pos AS INTEGER) AS pos, vec[pos + 1] AS value,
         'f' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature FROM vectors, positions),
gappy AS (
  SELECT * REPLACE (CASE WHEN pos < 8 AND (vec_id * 7 + pos) % 17 = 0 THEN NULL ELSE value END AS value) FROM features)"""
)


def _noise(seed: Column, model: int) -> Column:
    return ((F.col("k") * 7 + seed * 13 + F.col("event_id") * (model + 1)) % 41 - 20) / F.lit(10.0)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Seed-level predictions for two models: run = event, condition = stream."""
    s = samples(spark, sf)
    truth = F.least(F.lit(3), F.floor(F.col("value") / 50)).cast("int")
    base = s.select("subject", F.col("stream").alias("condition"), "event_id", "k", truth.alias("y_true"))
    exploded = base.select(
        "*", F.explode(F.array(*[F.lit(x) for x in SEEDS])).alias("seed")
    ).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("m"))
    noise = F.when(F.col("m") == 0, _noise(F.col("seed"), 0)).otherwise(_noise(F.col("seed"), 1) * 0.5)
    raw = F.col("y_true") + 1 + noise
    out = exploded.withColumn("y_pred_raw", raw)
    scores = F.array(*[1 - F.abs(F.col("y_pred_raw") - (c + 1)) / 4 for c in range(4)])
    return out.select(
        "subject", "condition", "event_id", "seed",
        F.when(F.col("m") == 0, "HDC").otherwise("TRADITIONAL").alias("model"),
        "y_true", (F.col("y_true") + 1).cast("double").alias("target_score"),
        "y_pred_raw", F.greatest(F.lit(1.0), F.least(F.lit(4.0), "y_pred_raw")).alias("y_pred_bounded"),
        scores.alias("scores"),
        (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("y_pred"),
    )


PREDICTIONS = (
    SAMPLES
    + """, pred0 AS (
  SELECT subject, stream AS condition, event_id, k, CAST(least(3, floor(value / 50)) AS INTEGER) AS y_true
  FROM samples),
pred1 AS (
  SELECT pred0.*, seed, m,
         y_true + 1 + CASE WHEN m = 0 THEN ((k * 7 + seed * 13 + event_id) % 41 - 20) / 10.0::DOUBLE
                           ELSE ((k * 7 + seed * 13 + event_id * 2) % 41 - 20) / 10.0::DOUBLE * 0.5::DOUBLE END AS y_pred_raw
  FROM pred0, (SELECT unnest([42, 43, 44, 45, 46]) AS seed), (SELECT unnest([0, 1]) AS m)),
pred2 AS (
  SELECT *, [1 - abs(y_pred_raw - 1) / 4, 1 - abs(y_pred_raw - 2) / 4, 1 - abs(y_pred_raw - 3) / 4, 1 - abs(y_pred_raw - 4) / 4] AS scores
  FROM pred1),
predictions AS (
  SELECT subject, condition, event_id, seed, CASE WHEN m = 0 THEN 'HDC' ELSE 'TRADITIONAL' END AS model, y_true,
         CAST(y_true + 1 AS DOUBLE) AS target_score, y_pred_raw, greatest(1.0::DOUBLE, least(4.0::DOUBLE, y_pred_raw)) AS y_pred_bounded,
         scores, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS y_pred
  FROM pred2)"""
)
