"""Gradient boosting over histograms: all classes at once, one grouped pass over the rows for each level of a round's trees.

Values become bin numbers once, by exact quantiles of the training rows. A pass works out the gradients of the rows from
their margins and adds them up by (class, node, feature, bin); the sums of all tasks are combined before and after the
shuffle, and only they reach the driver, which picks the splits. Sums of the last level also give the leaf values, so a
round of depth two takes two passes. Margins are written every ``WRITTEN`` rounds, and in between the few new trees are
applied on the fly.

The trees are those of the usual multinomial booster: one tree per class and round fitted to the residuals (indicator minus
soft-max share) by variance reduction, leaves by one Newton step.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

BINS = 32
#: Rounds between two written states of the margins; rows of a task.
WRITTEN, TASK_ROWS = 20, 50_000


@dataclass
class Tree:
    """A tree of full depth in heap order: node 1 is the root; a node that isn't split sends all rows to the left."""

    feature: np.ndarray
    cut: np.ndarray  # bins up to this one go left
    leaf: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def node_of(self, codes: np.ndarray, levels: int) -> np.ndarray:
        node = np.ones(len(codes), np.int64)
        row = np.arange(len(codes))
        for _ in range(levels):
            node = 2 * node + (codes[row, self.feature[node]] > self.cut[node])
        return node


@dataclass
class Booster:
    """Cuts of every position, start margins, and the trees of every round (one per class; one for regression)."""

    cuts: list[np.ndarray]
    start: np.ndarray
    rate: float
    depth: int
    squared: bool
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def codes(self, vectors: pa.Array) -> np.ndarray:
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        return np.stack([np.searchsorted(cut, x[:, j], "left") for j, cut in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def margins(self, codes: np.ndarray, rounds: Sequence[list[Tree]], margins: np.ndarray) -> np.ndarray:
        out = margins.copy()
        for trees in rounds:
            for c, tree in enumerate(trees):
                out[:, c] += self.rate * tree.leaf[tree.node_of(codes, self.depth) - (1 << self.depth)]
        return out

    def predict(self, rows: DataFrame, vec: str, rounds: int | None = None) -> Column:
        """Class shares (an array), or the predicted value for regression, after the first ``rounds`` rounds."""
        used, start, squared = self.rounds[:rounds], self.start, self.squared

        @F.arrow_udf("array<double>")
        def predicted(vectors: pa.Array) -> pa.Array:
            codes = self.codes(vectors)
            out = self.margins(codes, used, np.tile(start, (len(codes), 1)))
            out = out if squared else shares(out)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        return F.get(predicted(vec), F.lit(0)) if squared else predicted(vec)


def shares(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cuts_of(rows: DataFrame, vec: str, bins: int = BINS) -> list[np.ndarray]:
    """Distinct exact quantiles of every position, ``bins`` - 1 at most."""
    cell = rows.select(F.posexplode(vec).alias("pos", "value"))
    found = ordered.exact_quantiles(cell, ["pos"], "value", [i / bins for i in range(1, bins)], "q").collect()
    return [np.unique(r["q"]) for r in sorted(found, key=lambda r: r["pos"])]


def _gradients(booster: Booster, y: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Residuals, curvatures and summed loss."""
    if booster.squared:
        r = y[:, None] - margins
        return r, np.ones_like(r), float((r**2).sum())
    p = shares(margins)
    own = y.astype(np.int64)
    r = -p
    r[np.arange(len(y)), own] += 1
    return r, np.abs(r) * (1 - np.abs(r)), float(-np.log(p[np.arange(len(y)), own]).sum())


def _histograms(booster: Booster, recent: list[list[Tree]], growing: list[Tree] | None, level: int):
    dim, kinds = len(booster.cuts), len(booster.start)
    size = dim * BINS

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = 1 << level
        total, loss = np.zeros((kinds, nodes, 3 * size)), 0.0
        for batch in batches:
            codes, margins = _state(batch, dim, kinds)
            margins = booster.margins(codes, recent, margins)
            r, d, own = _gradients(booster, batch["y"].to_numpy(zero_copy_only=False), margins)
            loss += own
            place = np.arange(dim) * BINS + codes
            for c in range(kinds):
                node = growing[c].node_of(codes, level) - nodes if level else np.zeros(len(codes), np.int64)
                at = (place + node[:, None] * size).ravel()
                for s, weight in enumerate((None, r[:, c], d[:, c])):
                    sums = np.bincount(at, None if weight is None else np.repeat(weight, dim), nodes * size)
                    total[c, :, s * size : (s + 1) * size] += sums.reshape(nodes, size)
        sums = np.append(total.reshape(kinds * nodes, -1), np.zeros((kinds * nodes, 1)), axis=1)
        sums[0, -1] = loss
        ends = np.arange(len(sums) + 1) * sums.shape[1]
        yield pa.record_batch({
            "kind": pa.array(np.repeat(np.arange(kinds), nodes), pa.int32()), "node": pa.array(np.tile(np.arange(nodes), kinds), pa.int32()),
            "sums": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums.ravel())),
        })

    return histograms


def _state(batch: pa.RecordBatch, dim: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, dim)
    return codes, np.frombuffer(b"".join(batch["margins"].to_pylist()), np.float64).reshape(-1, kinds)


def _moved(booster: Booster, recent: list[list[Tree]]):
    """The rows with the margins after the recent rounds."""
    dim, kinds = len(booster.cuts), len(booster.start)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, margins = _state(batch, dim, kinds)
            margins = booster.margins(codes, recent, margins)
            yield pa.record_batch({"codes": batch["codes"], "y": batch["y"], "margins": pa.array([m.tobytes() for m in margins], pa.binary())})

    return moved


def _coded(booster: Booster, vec: str, target: str):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = booster.start.tobytes()
        for batch in batches:
            codes = booster.codes(batch[vec])
            yield pa.record_batch({"codes": pa.array([c.tobytes() for c in codes], pa.binary()), "y": batch[target].cast(pa.float64()), "margins": pa.array([start] * len(codes), pa.binary())})

    return coded


def _summed(rows: DataFrame, booster: Booster, recent: list[list[Tree]], growing: list[Tree] | None, level: int) -> tuple[np.ndarray, float]:
    """(class, node, statistic, feature, bin) sums of counts, residuals and curvatures; and the loss before this round."""
    parts = rows.mapInArrow(_histograms(booster, recent, growing, level), "kind int, node int, sums array<double>")
    total = parts.groupBy("kind", "node").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()
    out = np.zeros((len(booster.start), 1 << level, 3 * len(booster.cuts) * BINS + 1))
    for r in total:
        out[r["kind"], r["node"]] = r["sums"]
    return out[:, :, :-1].reshape(len(booster.start), 1 << level, 3, len(booster.cuts), BINS), float(out[0, 0, -1])


def gains(sums: np.ndarray) -> np.ndarray:
    """Reduction of the residuals' squared error for every (feature, bin) as the last bin on the left; -1 where a side is empty."""
    n, r = np.cumsum(sums[0], axis=1), np.cumsum(sums[1], axis=1)
    n_right, r_right = n[:, -1:] - n, r[:, -1:] - r
    both = (n > 0) & (n_right > 0) & (sums[0] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n * n_right / (n + n_right) * (r / n - r_right / n_right) ** 2
    return np.where(both, gain, -1.0)


def best_split(sums: np.ndarray) -> tuple[int, int, float]:
    """Feature, last bin on the left and gain; ties go to the first feature and the first bin; (0, BINS, 0) if nothing helps."""
    gain = gains(sums)
    at = int(gain.argmax())
    if gain.flat[at] <= 0:
        return 0, BINS, 0.0
    return at // BINS, at % BINS, float(gain.flat[at])


def _leaves(booster: Booster, tree: Tree, sums: np.ndarray) -> np.ndarray:
    """Newton steps of the leaves, from the sums of the nodes above them."""
    kinds, out = len(booster.start), np.zeros(2 * len(sums))
    scale = 1.0 if booster.squared else (kinds - 1) / kinds
    for n, own in enumerate(sums):
        f, cut = tree.feature[len(sums) + n], tree.cut[len(sums) + n]
        for side, part in enumerate((own[:, f, : cut + 1], own[:, f, cut + 1 :])):
            _, r, d = part.sum(axis=1)
            out[2 * n + side] = scale * r / d if abs(d) > 1e-150 else 0.0
    return out


def first_splits(rows: DataFrame, vec: str, label: str, classes: int) -> list[tuple[int, int, float, int, float]]:
    """(class, feature, cut, rows on the left, gain) of the trees that boosting begins with."""
    booster, state = _begun(rows, vec, label, classes, 0.1, 1)
    sums, _ = _summed(state, booster, [], None, 0)
    out = []
    for c in range(classes):
        f, cut, gain = best_split(sums[c, 0])
        out.append((c, f, float(booster.cuts[f][cut]) if gain > 0 else None, int(sums[c, 0, 0, f, : cut + 1].sum()), gain))
    return out


def _begun(rows: DataFrame, vec: str, target: str, classes: int | None, rate: float, depth: int) -> tuple[Booster, DataFrame]:
    rows = rows.where(F.col(target).isNotNull()).select(F.col(vec).alias("vec"), F.col(target).alias("y"))
    cuts = cuts_of(rows, "vec")
    if classes is None:
        n, mean = rows.agg(F.count(F.lit(1)), F.avg("y")).first()
        start = np.array([mean or 0.0])
    else:
        counts = dict(rows.groupBy("y").count().collect())
        if set(counts) - set(range(classes)):
            raise ValueError("a label is not a class number")
        n = sum(counts.values())
        with np.errstate(divide="ignore"):
            start = np.maximum(np.log(np.array([counts.get(c, 0) for c in range(classes)]) / max(n, 1)), -700.0)
    booster = Booster(cuts, start, rate, depth, classes is None)
    coded = rows.mapInArrow(_coded(booster, "vec", "y"), "codes binary, y double, margins binary")
    return booster, ordered.settle(coded.coalesce(max(1, -(-n // TASK_ROWS))))


def boost(rows: DataFrame, vec: str, target: str, classes: int | None, rounds: int = 100, rate: float = 0.1, depth: int = 2) -> Booster:
    """A booster for class numbers 0 to ``classes`` - 1, or for a numeric target under squared loss without ``classes``.

    ``rows`` hold an array of numbers without gaps, all of one length; rows without a target are left out. ``losses`` has
    the mean training loss before each round and after the last one. The driver holds (classes x nodes x features x bins)
    sums and the trees.
    """
    booster, state = _begun(rows, vec, target, classes, rate, depth)
    n, recent = state.count(), []
    for _ in range(rounds if n else 0):
        trees = [Tree(np.zeros(1 << depth, np.int64), np.full(1 << depth, BINS)) for _ in booster.start]
        for level in range(depth):
            sums, loss = _summed(state, booster, recent, trees, level)
            if level == 0:
                booster.losses.append(loss / n)
            for c, tree in enumerate(trees):
                for node in range(1 << level):
                    tree.feature[(1 << level) + node], tree.cut[(1 << level) + node], _ = best_split(sums[c, node])
        for c, tree in enumerate(trees):
            tree.leaf = _leaves(booster, tree, sums[c])
        booster.rounds.append(trees)
        recent = [*recent, trees]
        if len(recent) == WRITTEN:
            state, recent = ordered.settle(state.mapInArrow(_moved(booster, recent), state.schema)), []
    if n:
        booster.losses.append(_summed(state, booster, recent, None, 0)[1] / n)
    return booster
