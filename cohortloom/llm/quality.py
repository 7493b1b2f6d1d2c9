"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A token is a run of bytes above the space. Features are hashed n-grams of the tokens themselves (one and two) and of
their shapes (one to three). A shape says what kinds of characters a token has, how long it is, and whether it repeats
the token before it. A feature's value is ``SCALE`` times its share of all features of its kind in the text, so a
score is a sparse dot product that one pass over the tokens sums up.

Training is data-parallel: labelled rows are dealt to shards, each shard makes ``PASSES`` passes of per-coordinate
FTRL-proximal updates, and the shards' weights are averaged.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import samples, textbytes

#: Hash slots of the weight vector; the last extra one is the intercept.
DIM = 1 << 18
SCALE = 8.0
#: Labelled rows used for training, about; see ``samples.bounded``.
SAMPLE_ROWS = 16_384
SHARDS = 8
PASSES = 3
ALPHA, BETA, L1, L2 = 0.3, 0.1, 0.02, 0.05
THRESHOLD = 0.7

_ABOVE_SPACE = np.arange(256) > 32
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_MARK = _ABOVE_SPACE & ~_UPPER & ~_LOWER & ~_DIGIT & (_BYTE < 127)


def _count(data: np.ndarray, kind: np.ndarray, w: textbytes.Words) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind[data], out=total[1:])
    return total[w.end] - total[w.start]


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, numbers of the texts) of each kind of n-gram of a slice of texts."""
    w = textbytes.words(data, offsets, _ABOVE_SPACE)
    if not len(w.start):
        return []
    token = w.hashes()
    upper, lower, digit, mark = (_count(data, kind, w) for kind in (_UPPER, _LOWER, _DIGIT, _MARK))
    size = w.end - w.start
    again = np.zeros(len(token), bool)
    again[1:] = (token[1:] == token[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape = np.minimum(upper, 2) + 3 * np.minimum(lower, 1) + 6 * np.minimum(digit, 2) + 18 * np.minimum(mark, 3)
    shape = shape + 72 * (mark == size) + 144 * np.searchsorted([4, 12, 24], size, "right") + 576 * again
    shape = textbytes.mix(shape.astype(np.uint64) + np.uint64(1))
    out = []
    for salt, (h, n) in enumerate([(token, 1), (token, 2), (shape, 1), (shape, 2), (shape, 3)]):
        grams, first = textbytes.ngram_hashes(h, w.doc, n)
        slot = (textbytes.mix(grams + np.uint64(salt)) & np.uint64(DIM - 1)).astype(np.int32)
        out.append((slot, w.doc[first]))
    return out


def _train_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    pdf = pdf.sort_values(["text", "label"], kind="stable")
    rows = []
    for first, data, offsets in textbytes.slices(pa.array(pdf["text"])):
        kinds = [np.split(slot, np.searchsorted(doc, np.arange(1, len(offsets) - 1))) for slot, doc in features(data, offsets)]
        for i in range(len(offsets) - 1):
            slots, values = [np.array([DIM])], [np.ones(1)]
            for kind in kinds:
                found, times = np.unique(kind[i], return_counts=True)
                slots.append(found)
                values.append(SCALE * times / max(1, times.sum()))
            rows.append((np.concatenate(slots), np.concatenate(values).astype(np.float32), float(pdf["label"].iloc[first + i])))
    shuffle = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in shuffle.permutation(len(rows)):
            slots, x, y = rows[i]
            w = _weights(z[slots], n[slots])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            step = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            # kinds share slots only by a hash collision; the later value then stands
            z[slots] += g - step * w
            n[slots] += g * g
    w = _weights(z, n)
    keep = np.flatnonzero(w)
    rows.clear()
    textbytes.give_back()
    return pd.DataFrame({"slot": keep, "weight": w[keep]})


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.where(np.abs(z) <= L1, 0.0, z - np.sign(z) * L1)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def train(labelled: DataFrame) -> np.ndarray:
    """Weights from (text, label 0/1) rows; rows with a null label are left out, a null text counts as empty.

    ``labelled`` should be a bounded sample (``samples.labelled_texts``). Without any row all weights are 0, and every
    text scores 0.5. What reaches the driver are the averaged weights, ``DIM`` numbers at most.
    """
    rows = labelled.where(F.col("label").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(SHARDS)))
    shards = dealt.groupBy("shard").applyInPandas(lambda pdf: _train_shard(pdf), "slot int, weight double")
    mean = shards.groupBy("slot").agg((F.sum("weight") / SHARDS).alias("weight")).toPandas()
    w = np.zeros(DIM + 1, np.float32)
    w[mean["slot"].to_numpy(np.int64)] = mean["weight"].to_numpy()
    return w


def score_texts(texts: pa.Array, w: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), float(w[DIM]))
    for first, data, offsets in textbytes.slices(texts):
        n = len(offsets) - 1
        for slot, doc in features(data, offsets):
            total = np.bincount(doc, weights=w[slot], minlength=n)
            out[first : first + n] += SCALE * total / np.maximum(1, np.bincount(doc, minlength=n))
    textbytes.give_back()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(text: str | Column, w: np.ndarray) -> Column:
    """Probability of label 1 for a text column; a null or empty text gets the intercept's probability.

    ``w`` (1 MB whatever the corpus) travels to the executors once, as a broadcast variable.
    """
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(w)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts, shared.value))

    return scored(text)


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, modulus: int = 4, rest: int = 2) -> DataFrame:
    """``documents`` with held_out, score (0 to 1) and predicted (1 if score >= ``THRESHOLD``).

    Labels are learnt from ``labels`` (doc_id, label) rows outside the held-out remainder only. Every input row comes
    back once, repeated rows included; columns of the input named like the three are replaced.
    """
    usable = labels.where(F.col("label").isNotNull() & ~samples.is_held_out("doc_id", modulus, rest)).select("doc_id", "label")
    w = train(samples.labelled_texts(documents, usable, sample_rows))
    scored = documents.withColumn("held_out", samples.is_held_out("doc_id", modulus, rest)).withColumn("score", score("text", w))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
