"""Penalised linear models and their nested search on shared Gram matrices.

Rows are read twice, however many candidates there are: once for sums of products, once for the errors of all candidates on
their inner folds (columns with gaps need their medians before). Sums of products are kept per signature, that is, the inner
fold a row has in each outer training set; the matrix of any training set is a sum over signatures. Imputation, indicators,
standardisation and the ranking of features are linear algebra on that matrix: a column with gaps enters as its values
(0 where missing) and its gaps, and the imputed column is the first plus median times the second.

A system is one training set: a square matrix over the columns, solved in one task (``COLUMNS`` bounds its width).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds, ordered

#: Widest system: its matrix takes 8 bytes for each pair of columns.
COLUMNS = 4_096
#: A column whose spread is this share of its mean square or less is constant.
CONSTANT = 1e-12
RIDGE_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
RIDGE_TOPS = (50, 100, 200, "all")
NET_ALPHAS, NET_RATIOS = (0.001, 0.01, 0.1, 1.0), (0.1, 0.5, 0.9)


@dataclass(frozen=True)
class Layout:
    """Columns of the products: one, the shifted values, the gaps of ``gappy`` positions, the shifted target."""

    pivots: np.ndarray  # subtracted from the values, the target's last; sums of products stay small against the spread
    gappy: tuple[int, ...]

    @property
    def dim(self) -> int:
        return len(self.pivots) - 1

    def design(self, vectors: pa.Array) -> np.ndarray:
        """One, values (0 where missing) and gaps, a row for each vector."""
        flat = vectors.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, self.dim)
        gap = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, self.dim) | np.isnan(x)
        x = np.where(gap, 0.0, x - self.pivots[:-1])
        return np.hstack([np.ones((len(x), 1)), x, gap[:, list(self.gappy)]])


def layout(rows: DataFrame, vec: str, target: str) -> Layout:
    """Mean and gaps of every position, from one pass; a position without any value has the pivot 0."""
    cell = rows.select(F.posexplode(vec).alias("pos", "value"))
    found = cell.groupBy("pos").agg(F.avg("value").alias("mean"), F.count(F.when(F.col("value").isNull(), 1)).alias("gaps")).collect()
    if len(found) > COLUMNS:
        raise ValueError(f"{len(found)} columns; a system may have {COLUMNS}")
    pivots = np.zeros(len(found) + 1)
    for r in found:
        pivots[r["pos"]] = r["mean"] or 0.0
    pivots[-1] = rows.agg(F.avg(target)).first()[0] or 0.0
    return Layout(pivots, tuple(sorted(r["pos"] for r in found if r["gaps"])))


def _products(shape: Layout, vec: str, target: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(signature: str, total: np.ndarray) -> pa.RecordBatch:
        n = len(total)
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n + 1, n), pa.int32()), pa.array(total.ravel()))
        return pa.record_batch({"signature": [signature] * n, "row": pa.array(range(n), pa.int32()), "products": values})

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None
        for batch in batches:
            e = np.hstack([shape.design(batch[vec]), batch[target].to_numpy(zero_copy_only=False)[:, None] - shape.pivots[-1]])
            names = batch["signature"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if names[a] != own:
                    if own is not None:
                        yield emit(own, total)
                    own, total = names[a], np.zeros((e.shape[1], e.shape[1]))
                total += e[a:b].T @ e[a:b]
        if own is not None:
            yield emit(own, total)

    return products


def _summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = Summarizer.sum(array_to_vector(F.col("products")))
    return parts.groupBy(*keys).agg(vector_to_array(total).alias("products"))


def products(rows: DataFrame, shape: Layout, vec: str, target: str) -> DataFrame:
    """Sums of products per signature: one row for each row of its matrix. A task holds one matrix at a time."""
    ready = rows.select("signature", vec, F.col(target).cast("double").alias(target)).sortWithinPartitions("signature")
    parts = ready.mapInArrow(_products(shape, vec, target), "signature string, row int, products array<double>")
    return _summed(parts, ["signature", "row"])


# --- solving one system ------------------------------------------------------------------------


@dataclass
class System:
    """A training set after preparation: features in rank order, standardised (else sd is 1 and correlation holds covariances)."""

    n: float
    correlation: np.ndarray
    target: np.ndarray  # covariance with the target
    back: np.ndarray  # columns of the layout (rows) times ranked features
    mean: np.ndarray
    sd: np.ndarray
    y_mean: float

    def coefficients(self, w: np.ndarray) -> np.ndarray:
        """Intercept and weights over the columns of the layout; predictions are of the shifted target."""
        scaled = w / self.sd[: len(w)]
        out = self.back[:, : len(w)] @ scaled
        out[0] += self.y_mean - self.mean[: len(w)] @ scaled
        return out


def prepared(total: np.ndarray, shape: Layout, medians: dict[int, float], standardize: bool = True) -> System:
    """Median imputation and indicators, constant columns left out, standardised (ddof 0), ranked by the correlation with the
    target (its F score rises with it); equal ones put the later feature first, indicators come after all features.
    Without ``standardize`` columns are centred only."""
    n, dim = total[0, 0], shape.dim
    width = 1 + dim + len(shape.gappy)
    to = np.zeros((width, dim + len(shape.gappy)))
    to[np.arange(1, dim + 1), np.arange(dim)] = 1.0
    for j, pos in enumerate(shape.gappy):
        to[1 + dim + j, pos] = medians.get(pos, 0.0) - shape.pivots[pos]
        to[1 + dim + j, dim + j] = 1.0
    inner = total[:width, :width]
    sums = to.T @ inner[:, 0]
    square = to.T @ inner @ to
    mean, y_mean = sums / n, total[0, -1] / n
    cov = square / n - np.outer(mean, mean)
    cross = to.T @ total[:width, -1] / n - mean * y_mean
    variance, y_var = np.diagonal(cov), total[-1, -1] / n - y_mean**2
    alive = np.flatnonzero(variance > CONSTANT * np.diagonal(square) / n)
    share = cross[alive] ** 2 / (variance[alive] * y_var) if y_var > 0 else np.zeros(len(alive))
    order = alive[np.lexsort((-alive, -share))]
    sd = np.sqrt(variance[order]) if standardize else np.ones(len(order))
    correlation = cov[np.ix_(order, order)] / np.outer(sd, sd)
    if standardize:
        np.fill_diagonal(correlation, 1.0)
    return System(n, correlation, cross[order] / sd, to[:, order], mean[order], sd, y_mean)


def ridge_path(system: System, alphas: Sequence[float], sizes: Sequence[int]) -> dict[tuple[float, int], np.ndarray]:
    """Weights for every penalty (beside the sum of squared errors) and every number of leading features.

    A penalty takes one factorisation: the leading block of the Cholesky factor is the factor of the leading block.
    """
    out = {}
    for alpha in alphas:
        top = max(sizes, default=0)
        lower = np.linalg.cholesky(system.correlation[:top, :top] + alpha / system.n * np.eye(top))
        half = np.linalg.solve(lower, system.target[:top])
        for k in sizes:
            out[alpha, k] = np.linalg.solve(lower[:k, :k].T, half[:k])
    return out


def net_violation(c: np.ndarray, b: np.ndarray, w: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """How far each weight is from the optimality condition of (w'Cw - 2 b'w) / 2 + l1 |w| + l2 |w|^2 / 2."""
    g = b - c @ w - l2 * w
    return np.where(w != 0, np.abs(g - l1 * np.sign(w)), np.maximum(np.abs(g) - l1, 0.0))


def net_path(c: np.ndarray, b: np.ndarray, alphas: Sequence[float], ratio: float, sweeps: int = 10_000) -> dict[float, np.ndarray]:
    """Elastic net weights, from the largest penalty down, each starting from the one before.

    The strong rule leaves out features that the step of the penalty can't bring in; what it left out wrongly shows in the
    optimality conditions and comes back. Coordinate steps find the signs, the features in use are then solved for exactly.
    """
    w, before, out = np.zeros(len(b)), None, {}
    for alpha in sorted(alphas, reverse=True):
        l1, l2 = alpha * ratio, alpha * (1 - ratio)
        gradient = np.abs(b - c @ w - l2 * w)
        limit = l1 if before is None else 2 * l1 - before
        inside = (gradient >= limit) | (w != 0)
        for _ in range(sweeps):
            kept = np.flatnonzero(inside)
            sub, own = c[np.ix_(kept, kept)], w[kept].copy()
            rest = b[kept] - sub @ own
            for j in range(len(kept)):
                pull = rest[j] + sub[j, j] * own[j]
                new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (sub[j, j] + l2)
                if new != own[j]:
                    rest -= sub[:, j] * (new - own[j])
                    own[j] = new
            w = np.zeros(len(b))
            w[kept] = own
            used = np.flatnonzero(w)
            exact = w.copy()
            if len(used):
                exact[used] = np.linalg.solve(c[np.ix_(used, used)] + l2 * np.eye(len(used)), b[used] - l1 * np.sign(w[used]))
            off = net_violation(c, b, exact, l1, l2)
            if (np.sign(exact) == np.sign(w)).all():
                if off.max(initial=0.0) <= 1e-9:
                    w = exact
                    break
                inside |= off > 1e-9
        else:
            raise ArithmeticError("no convergence")
        out[alpha], before = w, l1
    return out


def _sizes(tops: Sequence[int | str], have: int) -> list[int]:
    return [have if k == "all" else min(int(k), have) for k in tops]


def solve(system: System, alphas: Sequence[float], tops: Sequence[int | str], ratios: Sequence[float] | None) -> list[tuple[float, float | None, str, int, np.ndarray, float]]:
    """(alpha, l1 ratio, requested k, effective k, weights, largest violation) of every candidate; ridge without ratios."""
    sizes = _sizes(tops, len(system.sd))
    out = []
    if ratios is None:
        path = ridge_path(system, alphas, sorted(set(sizes)))
        for alpha in alphas:
            for k, size in zip(tops, sizes):
                w = path[alpha, size]
                off = system.target[:size] - system.correlation[:size, :size] @ w - alpha / system.n * w
                out.append((alpha, None, str(k), size, w, float(np.abs(off).max(initial=0.0))))
        return out
    for size in sorted(set(sizes)):
        c, b = system.correlation[:size, :size], system.target[:size]
        for ratio in ratios:
            for alpha, w in net_path(c, b, alphas, ratio).items():
                off = float(net_violation(c, b, w, alpha * ratio, alpha * (1 - ratio)).max(initial=0.0))
                out += [(alpha, ratio, str(k), size, w, off) for k, s in zip(tops, sizes) if s == size]
    return out


_SOLVED = "outer_fold int, inner_fold int, alpha double, l1_ratio double, k string, effective_k int, coefficients array<double>, violation double"


def _solver(shape: Layout, medians: dict, alphas, tops, ratios, standardize: bool) -> Callable[[pa.Table], pa.Table]:
    def solved(table: pa.Table) -> pa.Table:
        outer, inner = table["outer_fold"][0].as_py(), table["inner_fold"][0].as_py()
        table = table.sort_by("row")
        total = np.stack(table["products"].to_numpy())
        system = prepared(total, shape, medians.get((outer, inner), {}), standardize)
        rows = [(outer, inner, a, r, k, e, system.coefficients(w), v) for a, r, k, e, w, v in solve(system, alphas, tops, ratios)]
        names = ["outer_fold", "inner_fold", "alpha", "l1_ratio", "k", "effective_k", "coefficients", "violation"]
        types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64()]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    return solved


# --- nested search -----------------------------------------------------------------------------


def signed(rows: DataFrame, group: str, fold: str, inner: DataFrame, k_outer: int) -> DataFrame:
    """``rows`` with inner (the inner fold in each outer training set, 0 in the row's own) and signature, its text.

    ``inner`` holds (group, outer_fold, inner_fold), one row for each outer fold that the group trains.
    """
    each = inner.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("outer_fold", "inner_fold"))).alias("_map"))
    places = F.transform(F.sequence(F.lit(1), F.lit(k_outer)), lambda o: F.coalesce(F.element_at("_map", o), F.lit(0)))
    marked = ordered.key_join(rows, each.select(group, places.alias("inner")), [group])
    own = F.element_at("inner", F.col(fold).cast("int"))
    problem = F.lit("a row's group trains its own outer fold")
    return marked.withColumn("signature", F.when(own == 0, F.array_join(F.col("inner").cast("array<string>"), ",")).otherwise(F.raise_error(problem).cast("string")))


def _trains(k_outer: int, k_inner: int, places) -> Column:
    """The systems (outer fold, inner fold left out; 0: none) that a signature's rows train."""
    systems = F.array(*[F.struct(F.lit(o).alias("outer_fold"), F.lit(i).alias("inner_fold")) for o in range(1, k_outer + 1) for i in range(k_inner + 1)])
    place = lambda s: F.element_at(places, s["outer_fold"])
    return F.explode(F.filter(systems, lambda s: (place(s) != 0) & (place(s) != s["inner_fold"])))


def _medians(rows: DataFrame, shape: Layout, vec: str, k_outer: int, k_inner: int) -> dict[tuple[int, int], dict[int, float]]:
    """Training medians of the columns with gaps, for every system."""
    if not shape.gappy:
        return {}
    cell = rows.select("inner", F.posexplode(vec).alias("pos", "value")).where(F.col("pos").isin(*shape.gappy) & F.col("value").isNotNull())
    copies = cell.select("pos", "value", _trains(k_outer, k_inner, F.col("inner")).alias("s")).select("pos", "value", "s.*")
    found = ordered.exact_quantiles(copies, ["outer_fold", "inner_fold", "pos"], "value", [0.5], "q").collect()
    out: dict[tuple[int, int], dict[int, float]] = {}
    for r in found:
        out.setdefault((r["outer_fold"], r["inner_fold"]), {})[r["pos"]] = r["q"][0]
    return out


def _errors(shape: Layout, vec: str, target: str, weights: dict[tuple[int, int], np.ndarray], low: float, high: float):
    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {cell: np.zeros(w.shape[1]) for cell, w in weights.items()}
        count = dict.fromkeys(weights, 0)
        for batch in batches:
            x = shape.design(batch[vec])
            y = batch[target].to_numpy(zero_copy_only=False)[:, None]
            inner = np.stack(batch["inner"].to_numpy(zero_copy_only=False))
            for (o, i), w in weights.items():
                here = inner[:, o - 1] == i
                if here.any():
                    total[o, i] += np.abs(np.clip(x[here] @ w + shape.pivots[-1], low, high) - y[here]).sum(axis=0)
                    count[o, i] += int(here.sum())
        for (o, i), sums in total.items():
            if n := count[o, i]:
                m = len(sums)
                yield pa.record_batch({"outer_fold": pa.array([o] * m, pa.int32()), "inner_fold": pa.array([i] * m, pa.int32()), "candidate": pa.array(range(m), pa.int32()), "error": sums, "rows": pa.array([n] * m, pa.int64())})

    return errors


@dataclass
class Search:
    """A nested search: ``table`` has every candidate of every outer fold, ``weights`` the refitted winner of each."""

    table: DataFrame
    weights: dict[int, np.ndarray]
    layout: Layout
    vec: str
    low: float
    high: float

    def predict(self, rows: DataFrame, fold: str) -> DataFrame:
        """``rows`` with prediction_raw and prediction_bounded by the model that did not see their outer fold."""
        shape, weights = self.layout, self.weights

        @F.arrow_udf("double")
        def predicted(vectors: pa.Array, own: pa.Array) -> pa.Array:
            x, f = shape.design(vectors), own.to_numpy(zero_copy_only=False)
            out = np.full(len(f), np.nan)
            for o, w in weights.items():
                out[f == o] = x[f == o] @ w + shape.pivots[-1]
            return pa.array(out)

        raw = rows.withColumn("prediction_raw", predicted(self.vec, F.col(fold).cast("int")))
        return raw.withColumn("prediction_bounded", F.greatest(F.lit(self.low), F.least(F.lit(self.high), "prediction_raw")))


def nested_search(
    rows: DataFrame, vec: str, target: str, group: str, fold: str, k_outer: int = 5, k_inner: int = 3, alphas: Sequence[float] = RIDGE_ALPHAS,
    tops: Sequence[int | str] = RIDGE_TOPS, ratios: Sequence[float] | None = None, inner: DataFrame | None = None, bounds: tuple[float, float] = (1.0, 4.0), standardize: bool = True,
) -> Search:
    """Every candidate (penalty, ratio, number of features) on the inner folds of every outer training set, and the refit.

    ``rows`` hold an array of numbers (nulls allowed, all of one length), a target, a group and an outer fold (1 to
    ``k_outer``). Inner folds isolate groups; they are dealt by size (``folds.nested_folds``) unless given. The score of a
    candidate is the mean over inner folds of the mean absolute error of bounded predictions; the least wins, equal ones by
    the larger penalty, the larger ratio, and the fewer features. Ridge without ``ratios``, else elastic net.

    Table: outer_fold, alpha, l1_ratio, k, effective_k (of the refit), mean_error, sd_error (over inner folds, ddof 0),
    violation (of the refit), selected. The driver holds one weight per column, candidate and training set.
    """
    spark = rows.sparkSession
    own = rows.where(F.col(target).isNotNull()).select(F.col(group).alias("group"), F.col(fold).alias("fold"), F.col(vec).alias("vec"), F.col(target).cast("double").alias("y"))
    inner = folds.nested_folds(own, "group", "fold", k_outer, k_inner) if inner is None else inner.withColumnRenamed(group, "group")
    own = ordered.settle(signed(own, "group", "fold", inner, k_outer).select("vec", "y", "inner", "signature"))
    shape = layout(own, "vec", "y")
    medians = _medians(own, shape, "vec", k_outer, k_inner)
    parts = products(own, shape, "vec", "y")
    places = F.split("signature", ",").cast("array<int>")
    systems = parts.select("row", "products", _trains(k_outer, k_inner, places).alias("s")).select("row", "products", "s.*")
    totals = _summed(systems, ["outer_fold", "inner_fold", "row"])
    solved = totals.groupBy("outer_fold", "inner_fold").applyInArrow(_solver(shape, medians, alphas, tops, ratios, standardize), _SOLVED).collect()
    name = lambda r: (r["alpha"], r["l1_ratio"], r["k"])
    candidates = [(a, r, str(k)) for k in tops for r in (ratios or [None]) for a in alphas]
    by_cell: dict[tuple[int, int], dict] = {}
    for r in solved:
        by_cell.setdefault((r["outer_fold"], r["inner_fold"]), {})[name(r)] = r
    weights = {cell: np.array([found[c]["coefficients"] for c in candidates]).T for cell, found in by_cell.items() if cell[1] > 0}
    scored = own.mapInArrow(_errors(shape, "vec", "y", weights, *bounds), "outer_fold int, inner_fold int, candidate int, error double, rows long")
    errors = scored.groupBy("outer_fold", "inner_fold", "candidate").agg((F.sum("error") / F.sum("rows")).alias("error")).collect()
    per_cell: dict[tuple[int, int], list[float]] = {}
    for e in sorted(errors, key=lambda e: e["inner_fold"]):
        per_cell.setdefault((e["outer_fold"], e["candidate"]), []).append(e["error"])
    out, chosen = [], {}
    for o in sorted({cell[0] for cell in by_cell}):
        scores = []
        for c, (alpha, ratio, k) in enumerate(candidates):
            refit = by_cell[o, 0][candidates[c]]
            own_errors = np.array(per_cell[o, c])
            scores.append((float(own_errors.mean()), -alpha, -(ratio or 0.0), refit["effective_k"], c))
            out.append([o, alpha, ratio, k, refit["effective_k"], float(own_errors.mean()), float(own_errors.std()), refit["violation"], False])
        best = min(scores)[-1]
        out[len(out) - len(candidates) + best][-1] = True
        chosen[o] = np.array(by_cell[o, 0][candidates[best]]["coefficients"])
    schema = "outer_fold int, alpha double, l1_ratio double, k string, effective_k int, mean_error double, sd_error double, violation double, selected boolean"
    return Search(spark.createDataFrame([tuple(r) for r in out], schema), chosen, shape, vec, *bounds)


def fit(rows: DataFrame, vec: str, target: str, alphas: Sequence[float], tops: Sequence[int | str] = ("all",), ratios: Sequence[float] | None = None, standardize: bool = True) -> DataFrame:
    """Weights of every candidate on all rows, gap-free: alpha, l1_ratio, k, effective_k, intercept, weights (per position of
    the given values, 0 for features left out), violation (largest distance from the optimality conditions)."""
    own = rows.where(F.col(target).isNotNull()).select(F.col(vec).alias(vec), F.col(target).cast("double").alias(target), F.lit("1").alias("signature"))
    shape = layout(own, vec, target)
    if shape.gappy:
        raise ValueError("values are missing; use nested_search, which imputes them")
    totals = products(own, shape, vec, target).select("row", "products", F.lit(1).alias("outer_fold"), F.lit(0).alias("inner_fold"))
    solved = totals.groupBy("outer_fold", "inner_fold").applyInArrow(_solver(shape, {}, alphas, tops, ratios, standardize), _SOLVED)
    pivots = F.array(*[F.lit(float(p)) for p in shape.pivots[:-1]])
    weights = F.slice("coefficients", 2, shape.dim)
    moved = F.aggregate(F.zip_with(weights, pivots, lambda w, p: w * p), F.lit(0.0), lambda a, v: a + v)
    intercept = F.element_at("coefficients", 1) + F.lit(float(shape.pivots[-1])) - moved
    return solved.select("alpha", "l1_ratio", "k", "effective_k", intercept.alias("intercept"), weights.alias("weights"), "violation")
