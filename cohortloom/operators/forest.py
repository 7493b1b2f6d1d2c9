"""Random forests whose trees stay on the executors: every task grows the part of a tree that its own rows reach.

Values become bin numbers once, by exact quantiles of the training rows. How often a tree draws a row is a digest of tree and
row (Poisson with mean one), so nothing is written for it. All rows, those to predict as well, go to every tree in blocks;
a task grows one tree's part on the drawn rows and leads the others down the same splits. Only what the trees say of each
row is sent back and added up by row.

A tree that more than ``PART_ROWS`` rows reach is first split from the top, a pass over the rows for each level, until no part
has more; the sums of a node are added up and its split is picked on the executors. The driver keeps these upper nodes only,
about one for every ``PART_ROWS`` rows and tree.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered
from .boosting import BINS, cuts_of

#: Rows (drawn or not) that a task grows a part of a tree with; rows of a block (two to this) and of a task that deals them out.
PART_ROWS, BLOCK_BITS, TASK_ROWS = 1 << 17, 13, 50_000
#: Numbers that the sums of the nodes searched together, or kept by a task, may have.
HELD = 4_000_000
#: Least gain of a split beside the rounding of the sums; partitions that parts of trees are dealt to at most.
LEAST_GAIN, MOST_PARTITIONS = 1e-12, 2000
_ROW, _MIXED = "_row", (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass
class Plan:
    """What all trees share. ``classes`` is None for regression, where sums are made of the target less ``mean``, over ``spread``."""

    cuts: list[np.ndarray]
    classes: int | None
    trees: int
    depth: int
    seed: int
    features: int
    mean: float
    spread: float

    @property
    def kinds(self) -> int:
        return self.classes or 2


@dataclass
class Top:
    """Upper nodes of a tree; a node without children is a part, grown by a task, or closed: a leaf."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    sums: list[np.ndarray | None] = field(default_factory=lambda: [None])
    open: list[bool] = field(default_factory=lambda: [True])  # to be split in the next pass
    closed: list[bool] = field(default_factory=lambda: [False])

    def place(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(codes), np.int64)
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        while len(at := np.flatnonzero(left[node] >= 0)):
            n = node[at]
            node[at] = left[n] + (codes[at, feature[n]] > cut[n])
        return node


def draws(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree draws each row: Poisson numbers with mean one."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) + np.uint64((tree + 1) * _MIXED[0] + seed * _MIXED[1] & (1 << 64) - 1)
        for shift, factor in ((30, _MIXED[1]), (27, _MIXED[2])):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    below = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
    return np.searchsorted(below, (x >> np.uint64(11)) / 2.0**53, "right")


def sums_of(plan: Plan, cell: np.ndarray, cells: int, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums by cell: drawn rows of every class, or drawn rows and their summed target. ``cell`` is (rows, any)."""
    wide = cell.shape[1]
    if plan.classes:
        at = cell * plan.classes + y.astype(np.int64)[:, None]
        return np.bincount(at.ravel(), np.repeat(w, wide), cells * plan.classes).reshape(cells, plan.classes)
    return np.stack([np.bincount(cell.ravel(), np.repeat(v, wide), cells) for v in (w, w * (y - plan.mean) / plan.spread)], axis=1)


def best_splits(plan: Plan, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (node, feature, bin, kind) sums the best feature and last bin on the left, and the gain: the fall of Gini
    impurity or of variance. Ties go to the first feature and bin; the gain is -1 where no split has rows on both sides."""
    left = np.cumsum(sums, axis=2)
    right = left[:, :, -1:] - left
    whole = left[:, :1, -1]
    if plan.classes:
        n_left, n_right, n = left.sum(-1), right.sum(-1), whole.sum(-1)
        score = [(x * x).sum(-1) for x in (left, right, whole)]
    else:
        n_left, n_right, n = left[..., 0], right[..., 0], whole[..., 0]
        score = [x[..., 1] * x[..., 1] for x in (left, right, whole)]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = [s / m for s, m in zip(score, (n_left, n_right, n))]
        gain = (share[0] + share[1] - share[2][:, :, None]) / n[:, :, None]
        gain = np.where((n_left > 0) & (n_right > 0), gain, -1.0).reshape(len(sums), -1)
    at = gain.argmax(axis=1)
    return at // BINS, at % BINS, gain[np.arange(len(sums)), at]


def chosen(plan: Plan, rng: np.random.Generator, nodes: int) -> np.ndarray:
    """The features that each node may be split by, in ascending order."""
    dim = len(plan.cuts)
    if plan.features >= dim:
        return np.tile(np.arange(dim), (nodes, 1))
    return np.sort(rng.random((nodes, dim)).argpartition(plan.features, axis=1)[:, : plan.features], axis=1)


def grow(plan: Plan, codes: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Grows a tree of at most ``depth`` levels on the rows of weight above 0; (leaf of every row, sums of every node).

    All nodes of a level are searched together, a bounded number at a time. As in Spark ML, two leaves of one class become one.
    """
    node = np.zeros(len(codes), np.int64)
    drawn = np.flatnonzero(w > 0)
    levels, sums, left = [0], [], []
    count = 1
    for level in range(depth + 1):
        lo, size = levels[-1], count - levels[-1]
        own = sums_of(plan, (node[drawn] - lo)[:, None], size, y[drawn], w[drawn])
        sums.append(own)
        children = np.full(size, -1, np.int64)
        left.append(children)
        many = (own > 0).sum(1) > 1 if plan.classes else np.bincount(node[drawn] - lo, minlength=size) > 1
        ready = np.flatnonzero(many) if level < depth else np.zeros(0, np.int64)
        picked = chosen(plan, rng, len(ready))
        feature, cut = np.zeros(size, np.int64), np.zeros(size, np.int64)
        drawn = drawn[np.argsort(node[drawn], kind="stable")]
        starts = np.searchsorted(node[drawn], lo + np.arange(size + 1))
        step = max(1, HELD // (plan.features * BINS * plan.kinds))
        for first in range(0, len(ready), step):
            some, may = ready[first : first + step], picked[first : first + step]
            per = starts[some + 1] - starts[some]
            rank = np.repeat(np.arange(len(some)), per)
            rows = drawn[np.arange(len(rank)) + np.repeat(starts[some] - (np.cumsum(per) - per), per)]
            place = (rank[:, None] * may.shape[1] + np.arange(may.shape[1])) * BINS + codes[rows[:, None], may[rank]]
            cells = sums_of(plan, place, len(some) * may.shape[1] * BINS, y[rows], w[rows])
            f, c, gain = best_splits(plan, cells.reshape(len(some), may.shape[1], BINS, -1))
            good = gain > LEAST_GAIN
            feature[some[good]], cut[some[good]] = may[np.arange(len(some)), f][good], c[good]
            children[some[good]] = 0
        split = np.flatnonzero(children == 0)
        if not len(split):
            break
        children[split] = count + 2 * np.arange(len(split))
        levels.append(count)
        count += 2 * len(split)
        # rows of this level go down; those in leaves above stay
        at = np.flatnonzero(node >= lo)
        at = at[children[node[at] - lo] >= 0]
        n = node[at] - lo
        node[at] = children[n] + (codes[at, feature[n]] > cut[n])
        drawn = drawn[node[drawn] >= levels[-1]]
    total, child = np.concatenate(sums), np.concatenate(left)
    return (_merged(node, total, child, levels), total) if plan.classes else (node, total)


def _merged(node: np.ndarray, sums: np.ndarray, left: np.ndarray, levels: list[int]) -> np.ndarray:
    """The leaf of every row after two leaves that name the same class have become one, from below."""
    best, parent, up = sums.argmax(1), np.arange(len(sums)), left.copy()
    for lo, hi in reversed([*zip(levels, [*levels[1:], len(sums)])]):
        at = lo + np.flatnonzero(up[lo:hi] >= 0)
        a = up[at]
        gone = at[(up[a] < 0) & (up[a + 1] < 0) & (best[a] == best[a + 1])]
        parent[up[gone]], parent[up[gone] + 1] = gone, gone
        up[gone] = -1
    for lo, hi in zip(levels, [*levels[1:], len(sums)]):  # from above: who was merged stands for those below
        parent[lo:hi] = parent[parent[lo:hi]]
    return parent[node]


def said(plan: Plan, sums: np.ndarray) -> np.ndarray:
    """What leaves with such sums say: shares of the classes; or the mean target, and a one that counts the tree."""
    n = sums.sum(1) if plan.classes else sums[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = sums / n[:, None] if plan.classes else np.stack([sums[:, 1] / n * plan.spread + plan.mean, np.ones(len(sums))], axis=1)
    return np.where(n[:, None] > 0, out, 0.0)


def _arrays(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, dim)
    return batch[_ROW].to_numpy(zero_copy_only=False), codes, batch["y"].to_numpy(zero_copy_only=False)


def _coded(plan: Plan):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            codes = np.stack([np.searchsorted(cut, x[:, j], "left") for j, cut in enumerate(plan.cuts)], axis=1).astype(np.uint8)
            own = batch.set_column(batch.schema.get_field_index("vec"), "codes", pa.array([c.tobytes() for c in codes], pa.binary()))
            yield own

    return coded


def _by_part(tops: list[Top], dim: int):
    """Blocks of rows for every part of every tree."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes, y = _arrays(batch, dim)
            block = rows >> BLOCK_BITS
            for tree, top in enumerate(tops):
                node = top.place(codes)
                out = []
                for b, n in sorted({*zip(block.tolist(), node.tolist())}):
                    if not top.closed[n]:
                        at = np.flatnonzero((block == b) & (node == n))
                        out.append((tree, n, rows[at].tobytes(), codes[at].tobytes(), y[at].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                        names=["tree", "part", "rows", "codes", "y"],
                    )

    return dealt


_BLOCKS = "tree int, part int, rows binary, codes binary, y binary"
_SAID = "block long, rows binary, said binary"


def _in_blocks(rows: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """``rows`` ascend."""
    block = rows >> BLOCK_BITS
    names, first = np.unique(block, return_index=True)
    ends = [*first[1:], len(rows)]
    return pa.RecordBatch.from_arrays([
        pa.array(names, pa.int64()), pa.array([rows[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
        pa.array([values[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
    ], names=["block", "rows", "said"])


def _grown(plan: Plan, tops: list[Top]):
    def grown(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        tree, part = (k.as_py() for k in key)
        rows = np.frombuffer(b"".join(blocks["rows"].to_pylist()), np.int64)
        codes = np.frombuffer(b"".join(blocks["codes"].to_pylist()), np.uint8).reshape(len(rows), -1)
        y = np.frombuffer(b"".join(blocks["y"].to_pylist()), np.float64)
        order = np.argsort(rows)
        rows, codes, y = rows[order], codes[order], y[order]
        w = np.where(np.isnan(y), 0, draws(rows, tree, plan.seed)).astype(np.float64)
        rng = np.random.default_rng([plan.seed, tree, part, 1])
        leaf, sums = grow(plan, codes, y, w, plan.depth - tops[tree].depth[part], rng)
        return pa.Table.from_batches([_in_blocks(rows, said(plan, sums)[leaf])])

    return grown


def _closed(plan: Plan, tops: list[Top], dim: int):
    """What upper leaves say of the rows that end there."""
    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes, _ = _arrays(batch, dim)
            order = np.argsort(rows)
            rows, codes = rows[order], codes[order]
            for top in tops:
                if any(top.closed):
                    node = top.place(codes)
                    leaf = np.array(top.closed)[node]
                    values = said(plan, np.stack([s if s is not None else np.zeros(plan.kinds) for s in top.sums]))
                    yield _in_blocks(rows[leaf], values[node[leaf]])

    return closed


def _added(plan: Plan):
    def added(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        total, seen = np.zeros((1 << BLOCK_BITS, plan.kinds)), np.zeros(1 << BLOCK_BITS, bool)
        spoken = sorted(zip(parts["rows"].to_pylist(), parts["said"].to_pylist()))  # one order of the sums whatever the order of tasks
        for rows, values in spoken:
            at = np.frombuffer(rows, np.int64) & ((1 << BLOCK_BITS) - 1)
            total[at] += np.frombuffer(values, np.float64).reshape(len(at), -1)
            seen[at] = True
        at = np.flatnonzero(seen)
        if plan.classes:
            prediction = total[at].argmax(1).astype(np.float64)
        else:
            prediction = total[at, 0] / np.maximum(total[at, 1], 1)
        return pa.table({_ROW: pa.array((key[0].as_py() << BLOCK_BITS) + at, pa.int64()), "prediction": pa.array(prediction)})

    return added


def _histograms(plan: Plan, tops: list[Top]):
    """(feature, bin, kind) sums of the open upper nodes, and in the last kind all rows, drawn or not."""
    dim, kinds = len(plan.cuts), plan.kinds + 1

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            rows, codes, y = _arrays(batch, dim)
            for tree, top in enumerate(tops):
                is_open = np.flatnonzero(top.open)
                if not len(is_open):
                    continue
                rank = np.full(len(top.open), -1)
                rank[is_open] = np.arange(len(is_open))
                own = rank[top.place(codes)]
                at = np.flatnonzero(own >= 0)
                own, may = own[at], _upper(plan, tree, is_open)
                wide = may.shape[1]
                cell = (own[:, None] * wide + np.arange(wide)) * BINS + codes[at[:, None], may[own]]
                cells = len(is_open) * wide * BINS
                w = np.where(np.isnan(y[at]), 0, draws(rows[at], tree, plan.seed)).astype(np.float64)
                d = w > 0
                sums = np.concatenate([sums_of(plan, cell[d], cells, y[at][d], w[d]), np.bincount(cell.ravel(), None, cells)[:, None]], axis=1)
                sums = sums.reshape(len(is_open), -1)
                held[tree] = held[tree] + sums if tree in held else sums
            if sum(h.size for h in held.values()) > HELD:
                yield from given(held)
                held = {}
        yield from given(held)

    def given(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for tree, sums in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([tree] * len(sums), pa.int32()), pa.array(np.flatnonzero(tops[tree].open), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary()),
            ], names=["tree", "node", "sums"])

    def picked(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        tree, node = (k.as_py() for k in key)
        total = sum(np.frombuffer(s, np.float64) for s in sorted(parts["sums"].to_pylist())).reshape(1, -1, BINS, kinds)
        f, cut, gain = best_splits(plan, total[..., :-1])
        own = total[0, f[0]]
        sides = [own[: cut[0] + 1].sum(0), own[cut[0] + 1 :].sum(0), own.sum(0)]
        feature = _upper(plan, tree, [node])[0, f[0]]
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([int(feature)], pa.int32()), "cut": pa.array([int(cut[0])], pa.int32()),
            "gain": pa.array([float(gain[0])]), "sides": pa.array([np.concatenate(sides).tolist()], pa.list_(pa.float64())),
        })

    return histograms, picked


def _upper(plan: Plan, tree: int, nodes) -> np.ndarray:
    """The features that upper nodes may be split by."""
    return np.concatenate([chosen(plan, np.random.default_rng([plan.seed, tree, int(n), 0]), 1) for n in nodes])


def _tops(plan: Plan, coded: DataFrame, n: int, part_rows: int) -> list[Top]:
    """Upper nodes of all trees, so that no part has more than ``part_rows`` rows unless it can't be split."""
    tops = [Top(open=[n > part_rows]) for _ in range(plan.trees)]
    while any(any(t.open) for t in tops):
        histograms, picked = _histograms(plan, tops)
        parts = coded.mapInArrow(histograms, "tree int, node int, sums binary")
        found = parts.groupBy("tree", "node").applyInArrow(picked, "tree int, node int, feature int, cut int, gain double, sides array<double>").collect()
        for top in tops:
            top.open = [False] * len(top.open)
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            top, sides = tops[r["tree"]], np.array(r["sides"]).reshape(3, -1)
            top.sums[r["node"]] = sides[2, :-1]
            if r["gain"] <= LEAST_GAIN or top.depth[r["node"]] >= plan.depth:
                top.closed[r["node"]] = True
                continue
            top.feature[r["node"]], top.cut[r["node"]], top.left[r["node"]] = r["feature"], r["cut"], len(top.left)
            for side in sides[:2]:
                for name, value in (("feature", 0), ("cut", 0), ("left", -1), ("depth", top.depth[r["node"]] + 1), ("sums", side[:-1]), ("closed", False)):
                    getattr(top, name).append(value)
                top.open.append(bool(side[-1] > part_rows))
    return tops


def predictions(
    df: DataFrame, train: Column, vec: str, target: str, classes: int | None, trees: int = 200, depth: int = 20, seed: int = 42, part_rows: int = PART_ROWS
) -> DataFrame:
    """Every row with a ``prediction`` (double) of the forest grown on the rows where ``train`` holds: the class that the trees'
    shares of classes favour, the lower one if equal, or without ``classes`` the mean of what the trees say.

    A node may be split by the square root of the features' number, or a third of them for regression. Labels are class numbers.
    """
    spread = df.withColumn("_trains", F.coalesce(train, F.lit(False)))
    x, y = F.col(vec), F.col(target).cast("double")
    whole = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    bad = y.isNull() | F.isnan(y)
    if classes:
        bad = bad | (y < 0) | (y >= classes) | (y != F.floor(y))
    learnt = spread.where("_trains")
    n_train, n_bad, least, most, mean, sd = learnt.agg(
        F.count(F.lit(1)), F.count(F.when(bad | ~F.coalesce(whole, F.lit(False)), 1)), F.min(F.size(x)), F.max(F.size(x)), F.avg(y), F.stddev_pop(y)
    ).first()
    if not n_train or n_bad or least != most:
        raise ValueError("training rows need a label, and vectors of one length without gaps")
    dim = most
    wrong, n = spread.agg(F.count(F.when(~F.coalesce(whole & (F.size(x) == dim), F.lit(False)), 1)), F.count(F.lit(1))).first()
    if wrong:
        raise ValueError("vectors to predict for need the length of the training vectors and no gaps")
    features = max(1, int(np.ceil(np.sqrt(dim) if classes else dim / 3)))
    plan = Plan(cuts_of(learnt, vec), classes, trees, depth, seed, features, 0.0 if classes else float(mean), sd or 1.0)
    dealt = spread.repartition(max(1, -(-n // TASK_ROWS))).withColumn(_ROW, F.monotonically_increasing_id())
    kept = ordered.settle(dealt)  # row numbers and blocks stay the same in every pass
    narrow = kept.select(_ROW, x.alias("vec"), F.when(F.col("_trains"), y).otherwise(F.lit(float("nan"))).alias("y"))
    coded = ordered.settle(narrow.mapInArrow(_coded(plan), f"{_ROW} long, codes binary, y double"))
    tops = _tops(plan, coded, n, part_rows)
    parts = sum(not shut and below < 0 for t in tops for shut, below in zip(t.closed, t.left))
    blocks = coded.mapInArrow(_by_part(tops, dim), _BLOCKS).repartition(max(1, min(parts, MOST_PARTITIONS)), "tree", "part")
    spoken = blocks.groupBy("tree", "part").applyInArrow(_grown(plan, tops), _SAID)
    if any(any(t.closed) for t in tops):
        spoken = spoken.unionByName(coded.mapInArrow(_closed(plan, tops, dim), _SAID))
    found = spoken.groupBy("block").applyInArrow(_added(plan), f"{_ROW} long, prediction double")
    return kept.join(found, _ROW).drop(_ROW, "_trains")
