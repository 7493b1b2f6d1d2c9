"""Linear support vector machines and regression by Newton steps, with a duality gap that proves how close they are.

One pass over the rows gives, for all models at once, the loss, the gradient, the second-derivative matrix and what the dual
objective needs; they are sums, combined before and after the shuffle. Passes go on until the gap between the objective and
its dual bound is below ``tolerance`` of the objective: there is no fixed number of them.

The intercept is the weight of a constant column and is penalised like the others, as in the usual library for these models.
The columns are bounded (``COLUMNS``); rows are not.
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

COLUMNS = 4_096
TOLERANCE = 1e-4
#: Passes after which a fit is given up as an error; a guard, not a stopping rule.
GIVE_UP = 500


@dataclass
class Machine:
    """A model: squared hinge against ``positive``, or (without it) distance from the target beyond ``epsilon``."""

    c: float
    positive: int | None = None
    epsilon: float = 0.0
    smooth: float = 1.0  # width over which the slope of the second kind's loss turns
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    objective: float = np.inf
    gap: float = np.inf
    passes: int = 0

    def terms(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float, np.ndarray, np.ndarray]:
        """Loss, smoothed loss, linear and quadratic part of the dual, each row's dual value and curvature."""
        value = x @ w
        if self.positive is not None:
            sign = np.where(y == self.positive, 1.0, -1.0)
            short = np.maximum(1 - sign * value, 0.0)
            dual = 2 * self.c * short
            loss = self.c * float(short @ short)
            return loss, loss, float(dual.sum() - dual @ dual / (4 * self.c)), dual * sign, 2 * self.c * (short > 0)
        rest, mu = y - value, self.smooth
        over, under = _logistic((rest - self.epsilon) / mu), _logistic((-rest - self.epsilon) / mu)
        dual = self.c * (over - under)
        loss = self.c * float(np.maximum(np.abs(rest) - self.epsilon, 0.0).sum())
        smoothed = self.c * mu * float((np.logaddexp(0, (rest - self.epsilon) / mu) + np.logaddexp(0, (-rest - self.epsilon) / mu)).sum())
        return loss, smoothed, float(y @ dual - self.epsilon * np.abs(dual).sum()), dual, self.c / mu * (over * (1 - over) + under * (1 - under))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _design(vectors: pa.Array) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return np.hstack([x, np.ones((len(x), 1))])


def _pass(machines: Sequence[Machine], points: Sequence[np.ndarray]):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(points[0])
        total = np.zeros((len(machines), 3 + dim + dim * dim))
        for batch in batches:
            x, y = _design(batch["x"]), batch["y"].to_numpy(zero_copy_only=False)
            for m, (machine, w) in enumerate(zip(machines, points)):
                loss, smoothed, linear, dual, curve = machine.terms(x, y, w)
                used = np.flatnonzero(curve)
                own = x[used]
                total[m, :3] += loss, smoothed, linear
                total[m, 3 : 3 + dim] += dual @ x
                total[m, 3 + dim :] += (own.T @ (own * curve[used, None])).ravel()
        ends = np.arange(len(machines) + 1) * total.shape[1]
        yield pa.record_batch({"machine": pa.array(range(len(machines)), pa.int32()), "sums": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(total.ravel()))})

    return sums


def fit(rows: DataFrame, vec: str, target: str, machines: Sequence[Machine], tolerance: float = TOLERANCE) -> list[Machine]:
    """The machines with weights (the constant's last), objective, gap (a share of the objective, 1 at least) and passes.

    ``rows`` hold gap-free arrays of one length and a class number or a numeric target; rows without a target are left out.
    A Newton step that does not lower the objective is halved. The second kind is smoothed, and the smoothing is halved
    when it hides more than further steps under it can gain.
    """
    own = ordered.settle(rows.where(F.col(target).isNotNull()).select(F.col(vec).alias("x"), F.col(target).cast("double").alias("y")))
    size = own.agg(F.max(F.size("x"))).first()[0]
    if size is None:
        raise ValueError("no rows to learn from")
    if size >= COLUMNS:
        raise ValueError(f"{size} columns; a machine may have {COLUMNS - 1}")
    dim = size + 1
    at = [np.zeros(dim) for _ in machines]
    best: list[tuple[float, np.ndarray] | None] = [None] * len(machines)  # smoothed objective and place
    steps = [np.zeros(dim) for _ in machines]
    open_ = list(range(len(machines)))
    for machine in machines:
        machine.objective = machine.gap = np.inf
        machine.passes = 0
    while open_:
        some = [machines[m] for m in open_]
        parts = own.mapInArrow(_pass(some, [at[m] for m in open_]), "machine int, sums array<double>")
        found = parts.groupBy("machine").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()
        for r in found:
            m = open_[r["machine"]]
            machine, s, w = machines[m], np.array(r["sums"]), at[m]
            machine.passes += 1
            pull, curve = s[3 : 3 + dim], s[3 + dim :].reshape(dim, dim)
            objective, smoothed = w @ w / 2 + s[0], w @ w / 2 + s[1]
            gap = (objective - (s[2] - pull @ pull / 2)) / max(1.0, objective)
            if gap < machine.gap:
                machine.w, machine.objective, machine.gap = w, float(objective), float(gap)
            if best[m] is not None and smoothed > best[m][0] + 1e-12 * abs(best[m][0]) and np.abs(steps[m]).max() > 1e-15:
                steps[m] = steps[m] / 2
                at[m] = best[m][1] + steps[m]
                continue
            gradient = w - pull
            step = -np.linalg.solve(np.eye(dim) + curve, gradient)
            # both bound what is left to gain under this smoothing; when that is less than what the smoothing hides, it shrinks
            if machine.positive is None and max(gradient @ gradient, -gradient @ step) / 2 < abs(objective - smoothed) / 2:
                machine.smooth /= 2
                best[m] = None
                continue
            best[m] = (smoothed, w)
            steps[m] = step
            at[m] = w + step
        open_ = [m for m in open_ if machines[m].gap > tolerance]
        if any(machines[m].passes >= GIVE_UP for m in open_):
            raise ArithmeticError(f"a gap is still above {tolerance} after {GIVE_UP} passes")
    return list(machines)


def squared_hinge(rows: DataFrame, vec: str, label: str, classes: int, c: float = 1.0, tolerance: float = TOLERANCE) -> list[Machine]:
    """One machine per class against the rest: |w|^2 / 2 + C sum max(0, 1 - y w x)^2."""
    return fit(rows, vec, label, [Machine(c, positive=k) for k in range(classes)], tolerance)


def insensitive(rows: DataFrame, vec: str, target: str, c: float = 1.0, epsilon: float = 0.1, tolerance: float = TOLERANCE) -> Machine:
    """|w|^2 / 2 + C sum max(0, |y - w x| - epsilon)."""
    return fit(rows, vec, target, [Machine(c, epsilon=epsilon)], tolerance)[0]


def values(vec: str | Column, machines: Sequence[Machine]) -> Column:
    """Decision values of the machines, an array."""
    weights = np.stack([m.w for m in machines])

    @F.arrow_udf("array<double>")
    def decided(vectors: pa.Array) -> pa.Array:
        out = _design(vectors) @ weights.T
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

    return decided(vec)
