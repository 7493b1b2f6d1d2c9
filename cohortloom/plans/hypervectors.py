"""Hypervector queries."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortloom.functions import vectors as hv
from cohortloom.functions.numeric import argmax_low, margin_and_runner_up
from cohortloom.operators import hdc, metrics, prep, tables

from .inputs import FEATURES, PREDICTIONS, VECTORS, features, predictions, r, table, vectors
from .registry import query

SEED, DIM, LEVELS = 42, 64, 11
NAMES = [f"f{i:02d}" for i in range(64)]
TRAIN = "subject % 5 <> 0"


def sign_sql(seed: str, role: str, ident: str, j: str) -> str:
    digest = f"md5({seed} || '|{role}|' || {ident} || '|' || ({j} // 128))"
    return f"(((instr('0123456789abcdef', substr({digest}, CAST(({j} % 128) // 4 AS INTEGER) + 1, 1)) - 1) >> CAST({j} % 4 AS INTEGER)) & 1) * 2 - 1"


COORDS = f"coords AS (SELECT unnest(range({DIM})) AS j)"


@query("h01_bipolar_vectors", f"""
WITH c AS (SELECT unnest(range(160)) AS j), s AS (SELECT p_partkey, j, {sign_sql("'7'", 'row', 'p_partkey', 'j')} AS v FROM part, c)
SELECT p_partkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY j) AS hv FROM s GROUP BY p_partkey""")
def h01(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(hv.bipolar_column(F.lit(7), "row", F.col("p_partkey"), 160), ",").alias("hv"))


@query("h01_published_vectors")
def h01_published(spark, sf):
    @F.pandas_udf("array<tinyint>")
    def make(ids):
        return ids.map(lambda i: hv.published_bipolar(SEED, "feature_identity", str(i), 256, "v1"))

    return table(spark, sf, "part").select("p_partkey", F.array_join(make("p_partkey"), ",").alias("hv"))


def level_sql(seed: str, levels: int, dim: int) -> str:
    """Level books for every row of ``seeds(seed)``."""
    half, g = dim // 2, levels - 1
    big, rest = half // g, half % g
    group = f"CASE WHEN p < {rest * (big + 1)} THEN p // {big + 1} ELSE {rest} + (p - {rest * (big + 1)}) // {big} END"
    return f"""lc AS (SELECT unnest(range({dim})) AS j),
perm AS (SELECT seed, j, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|level_permutation|{levels}|' || j), j) - 1 AS p, {sign_sql('seed', 'level_base', f"'{levels}'", 'j')} AS base FROM seeds, lc),
lv AS (SELECT unnest(range({levels})) AS level),
book AS (SELECT seed, level, j, CASE WHEN p < {half} AND ({group}) + 1 <= level THEN -base ELSE base END AS v FROM perm, lv)"""


@query("h02_level_codebook", f"""
WITH seeds AS (SELECT DISTINCT c_nationkey AS seed FROM customer), {level_sql('seed', 5, 40)}
SELECT seed, level, string_agg(CAST(v AS VARCHAR), ',' ORDER BY j) AS hv FROM book GROUP BY seed, level""")
def h02(spark, sf):
    books = table(spark, sf, "customer").select(F.col("c_nationkey").alias("seed")).distinct()

    @F.pandas_udf("array<array<tinyint>>")
    def make(seeds):
        return seeds.map(lambda s: hv.level_codebook(int(s), 5, 40).tolist())

    b = books.select("seed", F.posexplode(make("seed")).alias("level", "hv"))
    return b.select("seed", F.col("level").cast("long").alias("level"), F.array_join("hv", ",").alias("hv"))


@query("h03_bind", f"""
WITH c AS (SELECT unnest(range(32)) AS j), s AS (SELECT p_partkey, j, ({sign_sql("'7'", 'row', 'p_partkey', 'j')}) * ({sign_sql("'7'", 'size', 'p_size', 'j')}) AS v FROM part, c)
SELECT p_partkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY j) AS hv FROM s GROUP BY p_partkey""")
def h03(spark, sf):
    p = table(spark, sf, "part")
    a = hv.bipolar_column(F.lit(7), "row", F.col("p_partkey"), 32)
    b = hv.bipolar_column(F.lit(7), "size", F.col("p_size"), 32)
    return p.select("p_partkey", F.array_join(hv.bind(a, b), ",").alias("hv"))


QUANT = f"""{FEATURES}, rng AS (SELECT pos, min(value) AS lo, max(value) AS hi FROM features WHERE {TRAIN} GROUP BY pos),
lev AS (SELECT vec_id, subject, target_class, target_score, f.pos, feature, CASE WHEN hi > lo THEN CAST(greatest(0, least({LEVELS - 1}, floor((value - lo) / (hi - lo) * {LEVELS}))) AS INTEGER) ELSE 0 END AS level
  FROM features f JOIN rng r ON f.pos = r.pos)"""
ENCODE = f"""{QUANT}, seeds AS (SELECT {SEED} AS seed), {level_sql('seed', LEVELS, DIM)}, {COORDS},
ident AS (SELECT feature, j, {sign_sql(f"'{SEED}'", 'feature_identity', 'feature', 'j')} AS idv FROM (SELECT DISTINCT feature FROM features), coords),
tie AS (SELECT j, {sign_sql(f"'{SEED}'", 'bundle_tie', "'shared'", 'j')} AS tv FROM coords),
bundle AS (SELECT vec_id, any_value(subject) AS subject, any_value(target_class) AS target_class, any_value(target_score) AS target_score, i.j, sum(idv * v) AS s
  FROM lev l JOIN ident i ON l.feature = i.feature JOIN book b ON b.level = l.level AND b.j = i.j GROUP BY vec_id, i.j),
hvs AS (SELECT vec_id, subject, target_class, target_score, b.j, CASE WHEN s > 0 THEN 1 WHEN s < 0 THEN -1 ELSE tv END AS v FROM bundle b JOIN tie t ON b.j = t.j)"""


def quantized(spark, sf, levels=LEVELS):
    return hdc.quantize_vector(vectors(spark, sf), "vec", F.expr(TRAIN), levels)


def encoded(spark, sf, dim=DIM):
    q = quantized(spark, sf)
    if dim > 1000:  # a long vector costs far more than moving its 64 levels, so small files are spread out first
        q = q.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return q.withColumn("hv", hdc.encode(F.col("levels"), NAMES, LEVELS, SEED, dim))


@query("h04_encode", f"WITH {ENCODE} SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY j) AS hv FROM hvs GROUP BY vec_id")
def h04(spark, sf):
    return encoded(spark, sf).select("vec_id", F.array_join("hv", ",").alias("hv"))


@query("h04_encode_full_dimension")
def h04_full(spark, sf):
    e = encoded(spark, sf, 10_000)
    return e.select("vec_id", "target_class", F.aggregate("hv", F.lit(0), lambda a, x: a + x).alias("coordinate_sum"), F.size("hv").alias("dimension"))


RANKED = f"""scored AS (SELECT feature, pos, round(avg(value * target_class), 3) AS score FROM features WHERE {TRAIN} GROUP BY feature, pos),
ranked AS (SELECT feature, row_number() OVER (ORDER BY score DESC, pos DESC) AS rank FROM scored)"""


def ranking(spark, sf) -> list[int]:
    """Positions in rank order (one number per feature, so bounded by the schema)."""
    s = features(spark, sf).where(TRAIN).groupBy("feature", "pos").agg(r(F.avg(F.col("value") * F.col("target_class")), 3).alias("score"))
    ranked = tables.rank_features(s, [], "score", "pos").select("rank", "pos").collect()
    return [row["pos"] for row in sorted(ranked)]


KS = [8, 32, 64]


@query("h05_prefix_snapshots", f"""
WITH {ENCODE}, {RANKED}, terms AS (SELECT l.vec_id, i.j, rank, idv * v AS t FROM lev l JOIN ident i ON l.feature = i.feature JOIN book b ON b.level = l.level AND b.j = i.j JOIN ranked r ON r.feature = l.feature),
ks AS (SELECT unnest([8, 32, 64]) AS k), sums AS (SELECT vec_id, k, j, sum(t) AS s FROM terms JOIN ks ON rank <= k GROUP BY vec_id, k, j)
SELECT vec_id, k, string_agg(CAST(CASE WHEN s > 0 THEN 1 WHEN s < 0 THEN -1 ELSE tv END AS VARCHAR), ',' ORDER BY s.j) AS hv FROM sums s JOIN tie t ON s.j = t.j GROUP BY vec_id, k""")
def h05(spark, sf):
    q = quantized(spark, sf)
    e = q.select("vec_id", hdc.encode_prefixes(F.col("levels"), NAMES, ranking(spark, sf), KS, LEVELS, SEED, DIM).alias("p"))
    snaps = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p.k{k}").alias("hv")) for k in KS])
    return e.select("vec_id", F.explode(snaps).alias("s")).select("vec_id", "s.k", F.array_join("s.hv", ",").alias("hv"))


PROTO = f"proto AS (SELECT target_class AS label, j, sum(v) AS p FROM hvs WHERE {TRAIN} GROUP BY target_class, j)"


def trained(spark, sf, dim=DIM):
    e = encoded(spark, sf, dim)
    return e, hdc.prototypes(e.where(TRAIN), [], "target_class", "hv")


@query("h06_prototypes", f"WITH {ENCODE}, {PROTO} SELECT label, string_agg(CAST(p AS VARCHAR), ',' ORDER BY j) AS prototype FROM proto GROUP BY label")
def h06(spark, sf):
    _, p = trained(spark, sf)
    return p.select("label", F.array_join(F.transform("prototype", lambda x: x.cast("long")), ",").alias("prototype"))


SCORES = f"""dots AS (SELECT vec_id, any_value(subject) AS subject, any_value(target_class) AS target_class, any_value(target_score) AS target_score, label,
  round(greatest(-1, least(1, sum(v * p) / (sqrt(sum(v * v)) * sqrt(sum(p * p))))), 9) AS s FROM hvs JOIN proto ON hvs.j = proto.j GROUP BY vec_id, label),
sc AS (SELECT vec_id, any_value(subject) AS subject, any_value(target_class) AS target_class, any_value(target_score) AS target_score, list(s ORDER BY label) AS scores FROM dots GROUP BY vec_id)"""


def scored(spark, sf, dim=DIM):
    e, p = trained(spark, sf, dim)
    s = hdc.cosine_scores(F.col("hv"), F.lit(0), hdc.model_arrays(p, None))
    return e.withColumn("scores", F.transform(s, lambda x: F.round(x, 9)))


@query("h07_cosine_scores", f"WITH {ENCODE}, {PROTO}, {SCORES} SELECT vec_id, {', '.join(f'round(scores[{c + 1}], 7) + 0.0 AS class_score_{c}' for c in range(4))} FROM sc")
def h07(spark, sf):
    return scored(spark, sf).select("vec_id", *[r(F.get("scores", F.lit(c)), 7).alias(f"class_score_{c}") for c in range(4)])


@query("h08_nearest_prototype", f"WITH {ENCODE}, {PROTO}, {SCORES} SELECT vec_id, target_class, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS prediction FROM sc")
def h08(spark, sf):
    return scored(spark, sf).select("vec_id", "target_class", argmax_low(F.col("scores")).alias("prediction"))


@query("h12_margin_runner_up", f"""
WITH {ENCODE}, {PROTO}, {SCORES}, o AS (SELECT vec_id, target_class, scores, list_transform(scores, lambda x, i: CASE WHEN i = target_class + 1 THEN -2.0 ELSE x END) AS others FROM sc)
SELECT vec_id, round(scores[target_class + 1] - list_max(others), 7) + 0.0 AS margin, CAST(list_position(others, list_max(others)) - 1 AS INTEGER) AS runner_up FROM o""")
def h12(spark, sf):
    m = scored(spark, sf).select("vec_id", margin_and_runner_up(F.col("scores"), F.col("target_class")).alias("m"))
    return m.select("vec_id", r("m.margin", 7).alias("margin"), "m.runner_up")


@query("h09_multicentroid")
def h09(spark, sf):
    e = encoded(spark, sf, 256)
    c = hdc.fit_multicentroid(e.where(TRAIN), "target_class", "hv", 2, SEED)
    rows = c.orderBy("label", "centroid").collect()
    model = {None: np.array([row["prototype"] for row in rows])}
    s = e.withColumn("scores", hdc.cosine_scores(F.col("hv"), F.lit(0), model, per_class=2))
    return s.select("vec_id", "target_class", argmax_low(F.col("scores")).alias("prediction"), F.array_max("scores").alias("confidence"))


def fold_training(spark, sf, dim=256):
    """Encoded rows once per outer fold they train."""
    e = encoded(spark, sf, dim).withColumn("fold", (F.col("subject") % 5 + 1).cast("int"))
    return e, prep.train_copies(e.select("vec_id", "target_class", "hv", "fold"), "fold", 5)


def _learned(state, e, per_class):
    model = {row["outer_fold"]: np.array(row["state"]).reshape(4 * per_class, -1) for row in state.collect()}
    s = e.withColumn("scores", hdc.cosine_scores(F.col("hv"), F.col("fold"), model, per_class))
    return s.select("vec_id", "fold", F.col("target_class").alias("y_true"), argmax_low(F.col("scores")).alias("y_pred"))


@query("h10_online_updates")
def h10(spark, sf):
    e, train = fold_training(spark, sf)
    parts = hdc.prototypes(e, ["fold"], "target_class", "hv")
    protos = hdc.merge_prototypes(prep.train_copies(parts, "fold", 5), ["outer_fold"])
    state = hdc.fit_online(train, hdc.unit_prototypes(protos, ["outer_fold"]), ["outer_fold"], "vec_id", "target_class", "hv", 2, 0.05, 0.1, SEED)
    pred = _learned(state, e, 1)
    return metrics.classification_metrics(pred, ["fold"])


@query("h11_hybrid")
def h11(spark, sf):
    e = encoded(spark, sf, 256)
    train = e.where(TRAIN).withColumn("outer_fold", F.lit(1))
    start = hdc.centroid_state(hdc.fit_multicentroid(train, "target_class", "hv", 2, SEED)).withColumn("outer_fold", F.lit(1))
    state = hdc.fit_online(train, start, ["outer_fold"], "vec_id", "target_class", "hv", 1, 0.05, 0.0, SEED, per_class=2)
    return _learned(state, e.withColumn("fold", F.lit(1)), 2)


_SOFT = "greatest(1.0::DOUBLE, least(4.0::DOUBLE, list_sum(list_transform(scores, lambda s, i: exp((s - list_max(scores)) / t) * i)) / list_sum(list_transform(scores, lambda s: exp((s - list_max(scores)) / t)))))"


@query("h13_select_temperature", f"""
WITH {PREDICTIONS}, g AS (SELECT model, condition, seed, t, avg(abs({_SOFT} - target_score)) AS mae FROM predictions, (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.5, 1.0, 2.0]) AS t) GROUP BY model, condition, seed, t),
a AS (SELECT model, condition, t AS temperature, round(avg(mae), 9) AS mean_mae, round(stddev_samp(mae), 9) AS sd FROM g GROUP BY model, condition, t)
SELECT model, condition, temperature, round(mean_mae, 7) AS mean_mae FROM a QUALIFY row_number() OVER (PARTITION BY model, condition ORDER BY mean_mae, sd, temperature DESC) = 1""")
def h13(spark, sf):
    t = hdc.select_temperature(predictions(spark, sf), ["model", "condition"], "seed", "scores", "target_score")
    return t.select("model", "condition", "temperature", r("mean_mae", 7).alias("mean_mae"))


@query("h14_ridge_readout")
def h14(spark, sf):
    e = encoded(spark, sf, 256)
    model = hdc.fit_ridge(e.where(TRAIN), "hv", "target_score", 1.0, 256)
    return hdc.apply_ridge(model, e, "hv", 256).select("vec_id", "target_score", "prediction", "prediction_bounded")


# Two columns have a closed form: centre both, add the penalty to the diagonal, invert the 2 x 2 matrix.
@query("h14_ridge_two_columns", f"""
WITH {VECTORS}, d AS (SELECT vec_id, vec[1] / sqrt(2) AS a, vec[2] / sqrt(2) AS b, target_score AS y, {TRAIN} AS tr FROM vectors),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, regr_sxx(y, a) + 0.5 AS saa, regr_sxx(y, b) + 0.5 AS sbb, regr_sxy(b, a) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby FROM d WHERE tr),
w AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb FROM m)
SELECT vec_id, round(my + wa * (a - ma) + wb * (b - mb), 5) AS prediction FROM d, w""")
def h14_two(spark, sf):
    v = vectors(spark, sf).withColumn("pair", F.slice("vec", 1, 2))
    model = hdc.fit_ridge(v.where(TRAIN), "pair", "target_score", 0.5, 2)
    return hdc.apply_ridge(model, v, "pair", 2).select("vec_id", r("prediction", 5).alias("prediction"))


@query("h15_grid_search", f"""
WITH {ENCODE}, {RANKED}, terms AS (SELECT l.vec_id, l.subject, l.target_class, i.j, rank, idv * v AS t FROM lev l JOIN ident i ON l.feature = i.feature JOIN book b ON b.level = l.level AND b.j = i.j JOIN ranked r ON r.feature = l.feature),
ks AS (SELECT unnest([8, 32, 64]) AS k), sums AS (SELECT vec_id, any_value(subject) AS subject, any_value(target_class) AS y, k, j, sum(t) AS s FROM terms JOIN ks ON rank <= k GROUP BY vec_id, k, j),
h AS (SELECT vec_id, subject, subject % 5 AS inner_fold, y, k, s.j, CASE WHEN s > 0 THEN 1 WHEN s < 0 THEN -1 ELSE tv END AS v FROM sums s JOIN tie t ON s.j = t.j WHERE subject % 5 <> 0),
pr AS (SELECT f AS inner_fold, k, y AS label, j, sum(v) AS p FROM h, (SELECT unnest([1, 2, 3, 4]) AS f) WHERE inner_fold <> f GROUP BY ALL),
d AS (SELECT h.inner_fold, h.k, vec_id, any_value(y) AS y, label, round(sum(v * p) / (sqrt(sum(v * v)) * sqrt(sum(p * p))), 9) AS s FROM h JOIN pr ON h.inner_fold = pr.inner_fold AND h.k = pr.k AND h.j = pr.j GROUP BY h.inner_fold, h.k, vec_id, label),
b AS (SELECT inner_fold, k, vec_id, any_value(y) AS y_true, arg_max(label, s * 1e6 - label / 1e6) AS y_pred FROM d GROUP BY inner_fold, k, vec_id),
m AS (SELECT inner_fold, k, round(avg(CAST(y_true = y_pred AS DOUBLE)), 8) AS accuracy, round(avg(CAST(abs(y_true - y_pred) >= 2 AS DOUBLE)), 8) AS severe FROM b GROUP BY inner_fold, k)
SELECT k, round(avg(accuracy), 7) AS mean_accuracy, round(stddev_samp(accuracy), 7) AS sd_accuracy, round(avg(severe), 7) AS mean_severe,
  row_number() OVER (ORDER BY round(avg(accuracy), 7) DESC, round(stddev_samp(accuracy), 7), round(avg(severe), 7), k) = 1 AS selected FROM m GROUP BY k""")
def h15(spark, sf):
    """Feature-count candidates over inner folds: one encoding pass, per-fold prototype sums, one scoring pass."""
    q = quantized(spark, sf).where(TRAIN)
    q = q.withColumn("inner_fold", (F.col("subject") % 5).cast("int"))
    e = q.select("vec_id", "target_class", "inner_fold", hdc.encode_prefixes(F.col("levels"), NAMES, ranking(spark, sf), KS, LEVELS, SEED, DIM).alias("p"))
    snaps = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p.k{k}").alias("hv")) for k in KS])
    e = e.select("vec_id", "target_class", "inner_fold", F.explode(snaps).alias("s")).select("vec_id", "target_class", "inner_fold", "s.*")
    parts = hdc.prototypes(e, ["inner_fold", "k"], "target_class", "hv")
    others = F.filter(F.array(*[F.lit(i) for i in range(1, 5)]), lambda f: f != F.col("inner_fold"))
    held = hdc.merge_prototypes(parts.withColumn("out_fold", F.explode(others)), ["out_fold", "k"])
    keyed = held.withColumn("cell", F.concat_ws("|", "out_fold", "k"))
    s = e.withColumn("cell", F.concat_ws("|", "inner_fold", "k"))
    s = s.withColumn("scores", F.transform(hdc.cosine_scores(F.col("hv"), F.col("cell"), hdc.model_arrays(keyed, "cell")), lambda x: F.round(x, 9)))
    pred = s.select("k", "inner_fold", F.col("target_class").alias("y_true"), argmax_low(F.col("scores")).alias("y_pred"))
    m = metrics.classification_metrics(pred, ["k", "inner_fold"]).select("k", r("accuracy").alias("accuracy"), r("severe_error_rate").alias("severe"))
    g = m.groupBy("k").agg(r(F.avg("accuracy"), 7).alias("mean_accuracy"), r(F.stddev_samp("accuracy"), 7).alias("sd_accuracy"), r(F.avg("severe"), 7).alias("mean_severe"))
    best = g.agg(F.min_by("k", F.struct(-F.col("mean_accuracy"), "sd_accuracy", "mean_severe", "k"))).scalar()
    return g.withColumn("selected", F.col("k") == best)


@query("h16_model_bytes", """
SELECT source, lang, count(*) AS effective_k, (count(*) * 5000 + 51 * 5000 + 5000 + 80000 + 16 * count(*) + sum(n_chars))::BIGINT AS bytes FROM documents GROUP BY source, lang""")
def h16(spark, sf):
    g = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("effective_k"), F.sum("n_chars").alias("prep"))
    return g.select("source", "lang", "effective_k", hdc.model_bytes(F.col("effective_k"), F.lit(5000), F.lit(51), F.col("prep")).alias("bytes"))
