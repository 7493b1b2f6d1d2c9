"""Language of a text as a mixture: how much of it each language has written.

Every language has a model of hashed byte trigrams, smoothed, with a mark around each word. A text's units are its
words; a unit's likelihood under a language is the product over its trigrams. Expectation-maximisation estimates the
languages' shares of the units. Languages join the set one by one, the one that lifts the likelihood most first, and
only while the penalised likelihood (half the logarithm of the number of units for each share, at least
``LEAST_PENALTY``) still rises. The language with the largest share is the prediction, its share the score.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import columns, samples, textbytes

SLOTS = 1 << 15
SMOOTHING = 0.5
#: Training texts, about; see ``samples.bounded``.
SAMPLE_ROWS = 8_192
#: Rows a language gives at least, if it has them.
LEAST_ROWS = 64
EM_STEPS = 12
LEAST_PENALTY = 3.0
UNDETERMINED = "und"

_LETTERS = textbytes.runs_of("letters")
_FOLD = textbytes.fold_case(np.arange(256, dtype=np.uint8)).astype(np.uint64)


def trigrams(data: np.ndarray, w: textbytes.Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte trigrams of every word, with a mark before and after it, and the first trigram of each word.

    A word of b bytes has b trigrams.
    """
    size = w.end - w.start
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    at = np.arange(first[-1]) + np.repeat(w.start - first[:-1], size)
    middle = _FOLD[data[at]]
    left, right = np.empty_like(middle), np.empty_like(middle)
    left[1:], right[:-1] = middle[:-1], middle[1:]
    left[first[:-1]] = 1
    right[first[1:] - 1] = 2
    code = (left * np.uint64(0x9E3779B1) + middle * np.uint64(0x85EBCA77) + right * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    code = (code ^ (code >> np.uint64(15))) * np.uint64(0x2C1B3C6D)
    return ((code >> np.uint64(11)) & np.uint64(SLOTS - 1)).astype(np.int32), first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        names = pc.unique(batch["lang"]).to_pylist()
        for name in names:
            own = batch["text"].filter(pc.equal(batch["lang"], name))
            for _, data, offsets in textbytes.slices(own):
                w = textbytes.words(data, offsets, _LETTERS)
                if len(w.start):
                    slot, _ = trigrams(data, w)
                    total[name] = total.get(name, 0) + np.bincount(slot, minlength=SLOTS)
                else:
                    total.setdefault(name, np.zeros(SLOTS, np.int64))
    for name, n in total.items():
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(n[slot], pa.int64())], names=["lang", "slot", "n"])


def train(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names (sorted) and log-probabilities [slot, language] from (text, lang) rows; null languages are left out.

    What reaches the driver are counts, ``SLOTS`` per language at most.
    """
    rows = texts.where(F.col("lang").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    n = rows.mapInArrow(_counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(n["lang"].unique())
    table = np.full((SLOTS, len(names)), SMOOTHING, order="F")
    table[n["slot"].to_numpy(np.int64), np.searchsorted(names, n["lang"].to_numpy())] += n["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32, order="F") if names else table


class _Fits:
    """Likelihoods of the units of a slice's texts; mixtures are fitted for all texts at once."""

    def __init__(self, like: list[np.ndarray], doc: np.ndarray, n: int):
        """``like``: the units' likelihoods under each language, scaled so that a unit's best one is 1."""
        self.like, self.doc, self.n = like, doc, n
        self.units = np.bincount(doc, minlength=n)
        self.filled = np.flatnonzero(self.units)
        self.heads = np.searchsorted(doc, self.filled)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the units' values by text."""
        out = np.zeros(self.n)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(values, self.heads)
        return out

    def subset(self, keep: np.ndarray) -> _Fits:
        """The texts for which ``keep`` holds, and their units."""
        if keep.all():
            return self
        units = keep[self.doc]
        number = np.cumsum(keep) - 1
        return _Fits([x[units] for x in self.like], number[self.doc[units]], int(keep.sum()))

    def mixed(self, shares: np.ndarray) -> np.ndarray:
        return np.maximum(sum(x * shares[:, j][self.doc] for j, x in enumerate(self.like)), 1e-30)

    def fit(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares [text, place in members] over each text's member languages and the log-likelihood of each text."""
        table = np.stack(self.like)
        unit = np.arange(len(self.doc))
        like = [table[members[:, k][self.doc], unit] for k in range(members.shape[1])]
        shares = np.full(members.shape, 1 / members.shape[1])
        few = np.maximum(1, self.units)
        for _ in range(EM_STEPS):
            part = [x * shares[:, k][self.doc] for k, x in enumerate(like)]
            whole = np.maximum(sum(part), 1e-30)
            shares = np.stack([self.sums(x / whole) / few for x in part], axis=1)
        whole = sum(x * shares[:, k][self.doc] for k, x in enumerate(like))
        return shares, self.sums(np.log(np.maximum(whole, 1e-30)))


def mixtures(logs: list[np.ndarray], doc: np.ndarray, n: int) -> np.ndarray:
    """Shares [text, language] of the languages in the set that the penalised likelihood selects.

    ``logs`` are the units' log-likelihoods under each language. The likelihood is concave in the shares, so a language
    whose derivative at the present optimum is not positive can't raise it and is not fitted.
    """
    top = np.maximum.reduce(logs)
    fits = _Fits([np.exp(x - top) for x in logs], doc, n)
    single = np.stack([fits.sums(x - top) for x in logs], axis=1)
    rows = np.arange(n)
    members = single.argmax(axis=1)[:, None]
    best = single.max(axis=1)
    shares = np.zeros((n, len(logs)))
    shares[rows, members[:, 0]] = 1.0
    penalty = np.maximum(LEAST_PENALTY, 0.5 * np.log(np.maximum(1, fits.units)))
    texts = np.flatnonzero(fits.units > 1)  # those whose set may still grow
    members = members[texts]
    for _ in range(len(logs) - 1):
        keep = np.zeros(fits.n, bool)
        keep[texts] = True
        part = fits.subset(keep)
        mixed = part.mixed(shares[texts])
        slope = np.stack([part.sums(x / mixed) for x in part.like], axis=1) - part.units[:, None]
        np.put_along_axis(slope, members, -np.inf, axis=1)
        rising = slope.max(axis=1) > 0
        if not rising.any():
            break
        part, texts, slope, members = part.subset(rising), texts[rising], slope[rising], members[rising]
        members = np.concatenate([members, slope.argmax(axis=1)[:, None]], axis=1)
        new, value = part.fit(members)
        won = value - penalty[texts] > best[texts]
        texts, members = texts[won], members[won]
        if not len(texts):
            break
        best[texts] = (value[won] - penalty[texts])
        shares[texts] = 0.0
        shares[texts[:, None], members] = new[won]
    return shares


def predict_texts(texts: pa.Array, names: list[str], table: np.ndarray) -> pa.StructArray:
    lang = np.full(len(texts), UNDETERMINED, object)
    score = np.zeros(len(texts))
    for first, data, offsets in textbytes.slices(texts) if names else ():
        n = len(offsets) - 1
        w = textbytes.words(data, offsets, _LETTERS)
        if not len(w.start):
            continue
        slot, heads = trigrams(data, w)
        logs = [np.add.reduceat(table[:, k][slot], heads[:-1]) for k in range(len(names))]
        shares = mixtures(logs, w.doc, n)
        has = np.bincount(w.doc, minlength=n) > 0
        ascii_letter = np.zeros(n, bool)
        ascii_letter[w.doc[np.minimum.reduceat(np.where(_LETTERS[data], data, 255), w.start) < 128]] = True
        for i in np.flatnonzero(has & ~ascii_letter):  # only non-ASCII characters: are any of them letters?
            has[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
        top = shares.argmax(axis=1)
        lang[first : first + n] = np.where(has, np.array(names, object)[top], UNDETERMINED)
        score[first : first + n] = np.where(has, shares[np.arange(n), top], 0.0)
    textbytes.give_back()
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=["lang_pred", "score"])


def predict(text: str | Column, names: list[str], table: np.ndarray) -> Column:
    """(lang_pred, score) of a text column; ``und`` and 0 for texts that are null or have no letter."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast((names, table))

    @F.arrow_udf("lang_pred string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        return predict_texts(texts, *shared.value)

    return predicted(text)


def identify(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, modulus: int = 4, rest: int = 2) -> DataFrame:
    """``documents`` with held_out, lang_pred and score; every row once, repeated rows included.

    Models are learnt from about ``sample_rows`` rows with a language outside the held-out remainder, dealt over the
    languages so that each has a model; rows with a null id are learnt from too. Without any such row every text is ``und``. Columns named like the three are replaced, all others stay.
    """
    known = documents.where(F.col("lang").isNotNull() & ~samples.is_held_out("doc_id", modulus, rest))
    names, table = train(samples.bounded_by(known.select("doc_id", "text", "lang"), "lang", ["doc_id", "text"], sample_rows, LEAST_ROWS))
    (own,) = columns.fresh(documents, "_predicted")
    out = documents.withColumn("held_out", samples.is_held_out("doc_id", modulus, rest)).withColumn(own, predict("text", names, table))
    return out.withColumn("lang_pred", F.col(f"{own}.lang_pred")).withColumn("score", F.col(f"{own}.score")).drop(own)
