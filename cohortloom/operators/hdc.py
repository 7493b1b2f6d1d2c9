"""Hypervector encoding, prototypes, scoring and learners.

Codebooks and models are bounded by features x D and folds x classes x D, whatever the data size;
they travel to the tasks with the function that uses them. Rows never meet in one place: sums are
grouped partial sums, and the sequential learners walk bounded chunks that pass a model on.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom import session
from cohortloom.functions import vectors as hv
from cohortloom.functions.numeric import bound, softmax_expectation

from . import ordered
from .models import ridge
from .prep import quantize_level

CLASSES = (0, 1, 2, 3)
# Grids searched for the similarity temperature and the ridge penalty.
TEMPERATURES = [0.05, 0.1, 0.2, 0.5, 1.0, 2.0]
RIDGE_ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]

TINY = T.ArrayType(T.ByteType())
DOUBLES = T.ArrayType(T.DoubleType())


# --- encoding --------------------------------------------------------------------------------


def quantize_vector(df: DataFrame, vec: str, train: Column, levels: int, out: str = "levels") -> DataFrame:
    """Equal-width levels per position; the range comes from the training rows only."""
    rng = (
        df.where(train).select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("r")).scalar()
    )
    j = df.withColumn("_r", rng)
    level = F.transform(vec, lambda x, i: quantize_level(x, F.get("_r", i)["lo"], F.get("_r", i)["hi"], levels))
    return j.withColumn(out, level).drop("_r")


def encode_prefixes(levels: Column, names: Sequence[str], ranking: Sequence[int], ks: Sequence[int], n_levels: int, seed: int, dim: int) -> Column:
    """struct of hypervectors k<prefix>: sign of the running sum over ranked features, ties from a fixed vector."""
    ident = np.stack([hv.bipolar(seed, "feature_identity", n, dim) for n in names])
    book = hv.level_codebook(seed, n_levels, dim)
    tie = hv.bipolar(seed, "bundle_tie", "shared", dim)
    order, snaps = list(ranking), set(ks)
    wide = np.int16 if len(order) < 1 << 15 else np.int32
    block = max(1, (1 << 19) // dim)  # rows whose running sums fit in cache
    schema = T.StructType([T.StructField(f"k{k}", TINY) for k in ks])

    @F.pandas_udf(schema)
    def encode(batch: pd.Series) -> pd.DataFrame:
        at = np.stack(batch.to_numpy())
        out = {k: [] for k in ks}
        for start in range(0, len(at), block):
            part = at[start : start + block]
            total = np.zeros((len(part), dim), dtype=wide)
            recent = np.zeros((len(part), dim), dtype=np.int8)  # up to 127 terms of +-1 fit in a byte
            for n, f in enumerate(order, start=1):
                recent += book[part[:, f]] * ident[f]
                if n in snaps or n % 127 == 0:
                    total += recent
                    recent[:] = 0
                if n in snaps:
                    out[n].extend(np.where(total == 0, tie, np.sign(total)).astype(np.int8))
        return pd.DataFrame({f"k{k}": out[k] for k in ks})

    return encode(levels)


def encode(levels: Column, names: Sequence[str], n_levels: int, seed: int, dim: int) -> Column:
    n = len(names)
    return encode_prefixes(levels, names, range(n), [n], n_levels, seed, dim)[f"k{n}"]


# --- prototypes and scores ---------------------------------------------------------------------


def _whole(total: Column) -> Column:
    """The summarizer keeps sums as mean x weight; sums of signs are whole numbers."""
    return F.transform(vector_to_array(total), lambda x: F.rint(x))


def prototypes(df: DataFrame, keys: Sequence[str], label: str, vec: str) -> DataFrame:
    """Integer coordinate sums per (keys, class); partial sums combine before the shuffle."""
    total = Summarizer.sum(array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return df.groupBy(*keys, F.col(label).alias("label")).agg(_whole(total).alias("prototype"))


def merge_prototypes(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys, "label").agg(_whole(Summarizer.sum(array_to_vector("prototype"))).alias("prototype"))


def model_arrays(protos: DataFrame, key: str | None) -> dict:
    """Prototypes as numpy arrays per key: keys x classes x D numbers, bounded by the split design.

    Row c of an array is class c, so every key must have all classes from 0 on; an absent one is refused.
    """
    model: dict = {}
    for row in protos.select(*([key] if key else []), "label", "prototype").collect():
        k = row[key] if key else None
        model.setdefault(k, {})[row["label"]] = np.array(row["prototype"])
    labels = list(range(max((c for v in model.values() for c in v), default=-1) + 1))
    for k, v in model.items():
        if sorted(v) != labels:
            raise ValueError(f"classes {sorted(set(labels) - set(v))} have no prototype" + ("" if k is None else f" in {key} {k}"))
    return {k: np.stack([v[c] for c in labels]) for k, v in model.items()}


def cosine_scores(vec: Column, key: Column, model: Mapping, per_class: int = 1) -> Column:
    """Cosine to each class, clipped to [-1, 1]; the best of ``per_class`` centroids counts."""
    units = {k: m / np.linalg.norm(m, axis=1, keepdims=True) for k, m in model.items()}

    block = max(1, (1 << 19) // next((u.shape[1] for u in units.values()), 1))  # rows held as doubles at once, whatever the batch

    @F.pandas_udf(DOUBLES)
    def score(batch: pd.Series, which: pd.Series) -> pd.Series:
        vectors = batch.to_numpy()
        out = np.empty((len(vectors), len(next(iter(units.values()))) // per_class))
        keys = which.to_numpy(dtype=object) if None in units else which.to_numpy()
        for start in range(0, len(vectors), block):
            some = slice(start, start + block)
            x = np.stack(vectors[some]).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for k, u in units.items():
                at = np.flatnonzero(np.ones(len(x), dtype=bool) if k is None else keys[some] == k)
                s = np.clip(x[at] @ u.T, -1.0, 1.0)
                out[start + at] = s.reshape(len(s), -1, per_class).max(axis=2)
        return pd.Series(list(out))

    return score(vec, key)


# --- learners ----------------------------------------------------------------------------------


def _visit(model: np.ndarray, owner: np.ndarray, x: np.ndarray, label: int, rate: float, margin: float, cosine: bool) -> bool:
    """One correction: pull the label's best row, push the best other row; True when it moved."""
    sims = model @ x
    if cosine:
        sims = np.clip(sims / (np.linalg.norm(model, axis=1) * np.linalg.norm(x)), -1.0, 1.0)
    mine = owner == label
    own = int(np.where(mine, sims, -np.inf).argmax())
    rival = int(np.where(mine, -np.inf, sims).argmax())
    lead = sims[own] - sims[rival]
    lost = lead < 0 or (lead == 0 and owner[rival] < label)
    if not (lost or lead < margin):
        return False
    model[own] += rate * (1 - sims[own]) * x
    model[rival] -= rate * max(0.0, sims[rival]) * x
    return True


def fit_online(
    train: DataFrame, initial: DataFrame, keys: Sequence[str], ident: str, label: str, vec: str, epochs: int, rate: float, margin: float,
    seed: int, per_class: int = 1, chunk_rows: int = 10_000,
) -> DataFrame:
    """Sequential learner over class rows (``per_class`` = 1) or several centroids per class.

    ``initial`` holds keys and ``state``, the model's rows one after another. Visits follow a
    seeded hash order. A key's rows are cut into chunks of ``chunk_rows`` consecutive visits and
    the model passes from chunk to chunk, which gives the same result as one long walk; keys run
    in parallel. With ``per_class`` > 1 rows are scaled to unit length and similarity is the plain
    dot product. Rows of the model are brought to unit length after every epoch.
    """
    spark = train.sparkSession
    session.checkpoint_dir(spark)
    keys = list(keys)
    types = {f.name: f.dataType for f in train.schema.fields}
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField("state", DOUBLES), T.StructField("updates", T.LongType())])
    base = train.select(*keys, ident, label, vec)
    largest = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    chunks = -(-int(largest) // chunk_rows)

    def walk(rows: pd.DataFrame, model: pd.DataFrame, last: bool) -> pd.DataFrame:
        state = np.array(model["state"].iloc[0], dtype=float)
        updates = int(model["updates"].iloc[0])
        n_rows = len(CLASSES) * per_class
        m = state.reshape(n_rows, -1)
        owner = np.repeat(np.arange(len(CLASSES)), per_class)
        rows = rows.sort_values("_visit")
        for x, y in zip(rows[vec], rows[label]):
            x = np.asarray(x, dtype=float)
            if per_class > 1:
                x = x / np.linalg.norm(x)
            updates += _visit(m, owner, x, int(y), rate, margin, per_class == 1)
        if last:
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
        return model[keys].head(1).assign(state=[m.ravel().tolist()], updates=updates)

    def step(last: bool):
        return lambda rows, model: walk(rows, model, last)

    state = initial.select(*keys, "state", F.lit(0).cast("long").alias("updates"))
    for epoch in range(epochs):
        hashed = base.withColumn("_hash", F.xxhash64(F.lit(seed), F.lit(epoch), F.col(ident)))
        visits = ordered.row_numbers(hashed, keys, ["_hash", ident], "_visit").withColumn("_part", F.floor((F.col("_visit") - 1) / chunk_rows))
        if chunks > 1:  # one scan per chunk then reads only that chunk's files
            visits = _by_part(visits, spark)
        for c in range(chunks):
            both = visits.where(F.col("_part") == c).groupBy(*keys).cogroup(state.groupBy(*keys))
            state = both.applyInPandas(step(c == chunks - 1), schema).checkpoint()
    return state


def _by_part(df: DataFrame, spark) -> DataFrame:
    import uuid

    path = f"{session.checkpoint_dir(spark)}/visits-{uuid.uuid4().hex}"
    df.write.partitionBy("_part").parquet(path)
    return spark.read.parquet(path)


def unit_prototypes(protos: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class rows scaled to unit length, one flat ``state`` array per key."""
    norm = F.sqrt(F.aggregate("prototype", F.lit(0.0), lambda a, x: a + x * x))
    unit = protos.withColumn("_norm", norm).withColumn("_u", F.transform("prototype", lambda x: x / F.col("_norm")))
    packed = F.array_sort(F.collect_list(F.struct("label", "_u")))
    return unit.groupBy(*keys).agg(F.flatten(F.transform(packed, lambda s: s["_u"])).alias("state"))


def fit_multicentroid(train: DataFrame, label: str, vec: str, centroids: int, seed: int) -> DataFrame:
    """Unit centroids per class from distributed k-means on unit-length rows; one fit per class."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rows = train.withColumn("_norm", norm).select(
        F.col(label).alias("label"), array_to_vector(F.transform(vec, lambda x: x / F.col("_norm"))).alias("features")
    ).cache()
    fitted = []
    for c in CLASSES:
        model = KMeans(k=centroids, seed=seed + c, maxIter=300).fit(rows.where(F.col("label") == c))
        for i, center in enumerate(model.clusterCenters()):
            fitted.append((c, i, (center / np.linalg.norm(center)).tolist()))
    rows.unpersist()
    return train.sparkSession.createDataFrame(fitted, "label int, centroid int, prototype array<double>")


def centroid_state(centroids: DataFrame) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("label", "centroid", "prototype")))
    return centroids.agg(F.flatten(F.transform(packed, lambda s: s["prototype"])).alias("state"))


def select_temperature(df: DataFrame, keys: Sequence[str], split: str, scores: str, target: str, temperatures: Sequence[float] = TEMPERATURES) -> DataFrame:
    """Temperature of least mean inner error; ties by spread, then the larger temperature.

    All temperatures are scored in one pass as separate averages, so rows are not repeated.
    """
    def error(t: float) -> Column:
        return F.avg(F.abs(bound(softmax_expectation(F.col(scores), t), 1.0, 4.0) - F.col(target)))

    wide = df.groupBy(*keys, split).agg(*[error(t).alias(str(t)) for t in temperatures])
    long = wide.unpivot([*keys, split], [F.col(f"`{t}`") for t in temperatures], "temperature", "mae")
    g = long.groupBy(*keys, F.col("temperature").cast("double").alias("temperature")).agg(
        F.round(F.avg("mae"), 9).alias("mean_mae"), F.round(F.stddev_samp("mae"), 9).alias("sd_mae")
    )
    rank = F.struct("mean_mae", "sd_mae", -F.col("temperature"))
    return g.groupBy(*keys).agg(F.min_by(F.struct("temperature", "mean_mae"), rank).alias("_b")).select(*keys, "_b.*")


def fit_ridge(train: DataFrame, vec: str, target: str, alpha: float, dim: int):
    """Ridge read-out on vec / sqrt(D); gradients or a bounded Gram matrix are summed, rows never gathered."""
    data = train.select(
        array_to_vector(F.transform(vec, lambda x: x / F.lit(float(dim) ** 0.5))).alias("features"), F.col(target).cast("double").alias("label")
    )
    return ridge(data, alpha, dim)


def apply_ridge(model, df: DataFrame, vec: str, dim: int) -> DataFrame:
    x = df.withColumn("features", array_to_vector(F.transform(vec, lambda x: x / F.lit(float(dim) ** 0.5))))
    return model.transform(x).drop("features").withColumn("prediction_bounded", bound(F.col("prediction"), 1.0, 4.0))


def model_bytes(effective_k: Column, dim: Column, levels: Column, prep_bytes: Column) -> Column:
    """Identity and level books and the tie vector at 1 byte, prototypes at 4, quantiser ranges at 8."""
    return (effective_k * dim + levels * dim + dim + 4 * dim * 4 + 2 * effective_k * 8 + prep_bytes).cast("long")
