"""Validated, auditing and time-aligning joins."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordered


def _unique(df: DataFrame, on: Sequence[str], side: str) -> DataFrame:
    """Same rows, but the plan fails when a key repeats. Grouping on the join keys feeds the join's own shuffle."""
    rest = [c for c in df.columns if c not in on]
    packed = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(0).alias("_z"), *rest)).alias("_row"))
    fail = F.raise_error(F.concat(F.lit(f"duplicate key on {side} side: "), F.to_json(F.struct(*on))))
    # in a filter, as a check in an output column goes with the column when nobody asks for it
    checked = packed.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(fail.cast("boolean")))
    return checked.select(*on, *[F.col(f"_row.{c}").alias(c) for c in rest])


def join_validated(left: DataFrame, right: DataFrame, on: Sequence[str], validate: str = "one_to_one", how: str = "inner") -> DataFrame:
    """Equi-join that fails inside the plan when a side that must be unique repeats a key."""
    if validate not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(validate)
    l = _unique(left, on, "left") if validate.startswith("one_to") else left
    r = _unique(right, on, "right") if validate.endswith("to_one") else right
    return l.join(r, list(on), how)


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Full outer join: which side holds each key and whether every field agrees."""
    l = left.select(*on, F.struct(*fields).alias("_l"))
    r = right.select(*on, F.struct(*fields).alias("_r"))
    j = l.join(r, list(on), "full_outer")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    same = [F.col(f"_l.{f}").eqNullSafe(F.col(f"_r.{f}")).alias(f"{f}_equal") for f in fields]
    return j.select(*on, side.alias("side"), *same)


def keep_known(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def keep_unknown(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def coverage_gap(actual: DataFrame, unit: str, part: str, expected: DataFrame | None = None) -> DataFrame:
    """Missing and unexpected (unit, part) combinations against a per-unit grid.

    ``expected`` lists the parts each unit should have (default: every part seen anywhere).  Only
    the set of parts travels to each unit; the grid itself is never built, so the output is the
    gap and not units x parts.
    """
    parts = (expected if expected is not None else actual).select(part).distinct()
    wanted = parts.agg(F.array_sort(F.collect_set(part)).alias("w")).scalar()
    seen = actual.select(unit, part).distinct().groupBy(unit).agg(F.collect_set(part).alias("_seen"))
    both = seen.withColumn("_wanted", wanted)
    missing = F.transform(F.array_except("_wanted", "_seen"), lambda p: F.struct(p.alias(part), F.lit("missing").alias("status")))
    extra = F.transform(F.array_except("_seen", "_wanted"), lambda p: F.struct(p.alias(part), F.lit("extra").alias("status")))
    return both.select(unit, F.explode(F.concat(missing, extra)).alias("_g")).select(unit, "_g.*")


def paired(df: DataFrame, unit: Sequence[str], condition: str, left: str, right: str, value: str) -> DataFrame:
    """One row per unit holding both conditions' values; a repeated (unit, condition) fails."""
    is_l, is_r = F.col(condition) == left, F.col(condition) == right
    g = df.where(is_l | is_r).groupBy(*unit).agg(
        F.count(F.when(is_l, 1)).alias("_nl"), F.count(F.when(is_r, 1)).alias("_nr"),
        F.max(F.when(is_l, F.col(value))).alias("_l"), F.max(F.when(is_r, F.col(value))).alias("_r"),
    )
    single = (F.col("_nl") <= 1) & (F.col("_nr") <= 1)
    checked = F.when(single, F.lit(True)).otherwise(F.raise_error(F.lit("repeated unit in a paired comparison")).cast("boolean"))
    both = g.where(checked).where((F.col("_nl") > 0) & (F.col("_nr") > 0))
    return both.select(*unit, F.col("_l").alias("left_value"), F.col("_r").alias("right_value"))


def asof_align(
    left: DataFrame, right: DataFrame, by: Sequence[str], t: str, columns: Sequence[str], tie: str, tolerance: float | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Latest ``right`` columns at or before each ``left`` row's time, per ``by``; NULL beyond ``tolerance``.

    The streams are merged in time order and the last right row is carried forward, so no pairs
    are formed and a long stream is cut into time ranges.  ``tie`` is the row id on both sides.
    """
    packed = F.struct(F.col(t).alias("_rt"), *columns)
    empty = F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType)
    r = right.select(*by, t, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), packed.alias("_right"))
    keep = F.struct(*left.columns)
    r = r.withColumn("_left", F.lit(None).cast(left.select(keep.alias("x")).schema["x"].dataType))
    l = left.select(*by, t, F.lit(1).alias("_side"), F.col(tie).alias("_tie"), empty.alias("_right"), keep.alias("_left"))
    merged = l.unionByName(r)
    carried = ordered.running(merged, by, [t, "_side", "_tie"], {"_match": ("last", "_right")}, rows_per_chunk=rows_per_chunk)
    rows = carried.where(F.col("_side") == 1)
    near = F.lit(True) if tolerance is None else (F.col(t) - F.col("_match._rt") <= tolerance)
    return rows.select("_left.*", *[F.when(near, F.col(f"_match.{c}")).alias(f"right_{c}") for c in columns])


def excerpt_by_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Samples lo..hi (0-based, hi excluded) of each stream."""
    numbered = ordered.row_numbers(df, keys, order, "_rn")
    return numbered.where((F.col("_rn") > lo) & (F.col("_rn") <= hi)).drop("_rn")


def excerpt_by_time(df: DataFrame, t: str, lo: float, hi: float) -> DataFrame:
    return df.where((F.col(t) >= lo) & (F.col(t) < hi))


# --- nearest neighbours ----------------------------------------------------------------------
# Train rows belong to the cell of their nearest pivot.  The triangle inequality bounds the distance
# from a query to every row of a cell, so a query only visits cells that can hold one of its k
# nearest rows.  Cells are cut into blocks on both sides; a block pair yields k rows per query.

PIVOTS = 16
BLOCK_ROWS = 20_000
HELD_DISTANCES = 1_000_000  # distances a task holds at a time (8 MB, and as much for their order where all are ranked)

CACHED_ROWS = 1024  # rows that are compared with one row after another


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        d = np.abs(b - row)
        out[i] = d.sum(axis=1) if p == 1 else np.sqrt((d * d).sum(axis=1))
    return out


def _reach(a: np.ndarray, b: np.ndarray, p: int, k: int) -> np.ndarray | None:
    """Which rows of ``b`` may be among the k nearest of each row of ``a``: a superset from rounded distances; None if they fail.

    Euclidean ones are squared and come from one matrix product, the others from single precision. The limit of a row is the
    k-th smallest of group minima, which k rows reach, and is widened by more than rounding can move a distance.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        if p == 1:
            rows, near, ones = a.astype(np.float32), np.empty((len(a), len(b)), np.float32), np.ones(b.shape[1], np.float32)
            for at in range(0, len(b), CACHED_ROWS):
                small = b[at:at + CACHED_ROWS].astype(np.float32)
                gap = np.empty_like(small)
                for i, row in enumerate(rows):
                    np.subtract(small, row, out=gap)
                    np.abs(gap, out=gap)
                    np.dot(gap, ones, out=near[i, at:at + len(gap)])
            slack = np.abs(a).sum(axis=1) + np.abs(b).sum(axis=1).max()
            slack = slack * (4 * (b.shape[1] + 8) * np.finfo(np.float32).eps) + 1e-30
        else:
            own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
            near = a @ b.T
            near *= -2
            near += other
            near += own[:, None]
            slack = (own + other.max()) * (8 * (b.shape[1] + 8) * np.finfo(float).eps) + 1e-290
        groups = max(4 * k, 256)
        whole = len(b) // groups * groups
        least = near[:, whole:]
        if whole:
            least = np.concatenate([near[:, :whole].reshape(len(a), -1, groups).min(axis=1), least], axis=1)
        limit = np.partition(least, k - 1, axis=1)[:, k - 1].astype(float) + slack
    if not (np.isfinite(limit).all() and np.isfinite(slack).all()):
        return None
    # rows are compared in the precision of ``near``, so the limit is rounded up
    return near <= np.nextafter(limit.astype(near.dtype), np.array(np.inf, near.dtype))[:, None]


def _nearest(a: np.ndarray, b: np.ndarray, p: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``b`` and distances of the k nearest rows of each row of ``a``; ties go to the lower place."""
    plain = len(b) <= k or not (np.isfinite(a).all() and np.isfinite(b).all())
    reach = None if plain else _reach(a, b, p, k)
    if reach is None:
        d = _distances(a, b, p)
        top = np.argsort(d, axis=1, kind="stable")[:, :k].copy()  # a view would keep the whole order
        return top, np.take_along_axis(d, top, axis=1)
    top, near = np.empty((len(a), k), np.int64), np.empty((len(a), k))
    for i, row in enumerate(reach):
        some = np.flatnonzero(row)
        d = _distances(a[i : i + 1], b[some], p)[0]
        best = np.argsort(d, kind="stable")[:k]
        top[i], near[i] = some[best], d[best]
    return top, near


def knn_join(test: DataFrame, train: DataFrame, key: str, vec: str, label: str, k: int, p: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest train rows per test row (Minkowski p = 1 or 2); ties go to the lower train key."""
    picked = train.orderBy(F.xxhash64(key), key).limit(PIVOTS).select(vec).collect()
    pivots = np.array([row[0] for row in picked], dtype=float)

    @F.pandas_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())]))
    def nearest_pivot(v: pd.Series) -> pd.DataFrame:
        d = _distances(np.stack(v.to_numpy()), pivots, p)
        best = d.argmin(axis=1)
        return pd.DataFrame({"cell": best, "radius": d[np.arange(len(d)), best]})

    placed = train.select(key, vec, label, nearest_pivot(vec).alias("_c")).select(key, vec, label, "_c.*")
    spans = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")).collect()
    low = np.full(len(pivots), np.inf)
    high = np.full(len(pivots), -np.inf)
    size = np.zeros(len(pivots), dtype=int)
    for s in spans:
        low[s["cell"]], high[s["cell"]], size[s["cell"]] = s["lo"], s["hi"], s["n"]

    # Upper bound on a query's k-th distance: whole cells, nearest first, until k rows are covered.
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells_to_visit(v: pd.Series) -> pd.Series:
        d = _distances(np.stack(v.to_numpy()), pivots, p)
        far = np.where(size > 0, d + high, np.inf)
        order = np.argsort(far, axis=1)
        covered = np.cumsum(size[order], axis=1)
        at = np.minimum((covered < k).sum(axis=1), len(pivots) - 1)
        limit = far[np.arange(len(d)), order[np.arange(len(d)), at]]
        nearest_possible = np.maximum(np.maximum(d - high, low - d), 0)
        visit = (size > 0) & (nearest_possible <= limit[:, None] * (1 + 1e-12) + 1e-12)
        return pd.Series([np.flatnonzero(row).astype(int) for row in visit])

    queries = test.select(F.col(key).alias("_q"), F.col(vec).alias("_qv"), F.explode(cells_to_visit(vec)).alias("cell"))
    asked = {row["cell"]: row["n"] for row in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    s_blocks = F.element_at(F.array(*[F.lit(int(-(-int(n) // block_rows)) or 1) for n in size]), F.col("cell") + 1)
    q_blocks = F.element_at(
        F.array(*[F.lit(int(-(-int(asked.get(i, 0)) // block_rows)) or 1) for i in range(len(pivots))]), F.col("cell") + 1
    )
    zero = F.lit(0).cast("long")
    train_side = placed.withColumn("_sb", F.pmod(F.xxhash64(key), s_blocks)).withColumn(
        "_qb", F.explode(F.sequence(zero, q_blocks.cast("long") - 1))
    )
    query_side = queries.withColumn("_qb", F.pmod(F.xxhash64("_q"), q_blocks)).withColumn(
        "_sb", F.explode(F.sequence(zero, s_blocks.cast("long") - 1))
    )
    schema = T.StructType([
        T.StructField("_q", test.schema[key].dataType), T.StructField("neighbor", train.schema[key].dataType),
        T.StructField("neighbor_label", train.schema[label].dataType), T.StructField("distance", T.DoubleType()),
    ])

    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if q.empty or s.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        s = s.sort_values(key)
        asked, known = np.stack(q["_qv"].to_numpy()), np.stack(s[vec].to_numpy())
        step = max(1, HELD_DISTANCES // len(known))
        tops, nearest = [], []
        for i in range(0, len(asked), step):
            top, near = _nearest(asked[i:i + step], known, p, k)
            tops.append(top)
            nearest.append(near)
        top = np.concatenate(tops)
        width = top.shape[1]
        return pd.DataFrame({
            "_q": np.repeat(q["_q"].to_numpy(), width), "neighbor": s[key].to_numpy()[top].ravel(),
            "neighbor_label": s[label].to_numpy()[top].ravel(), "distance": np.concatenate(nearest).ravel(),
        })

    by = ["cell", "_sb", "_qb"]
    found = query_side.groupBy(*by).cogroup(train_side.groupBy(*by)).applyInPandas(block, schema)
    w = Window.partitionBy("_q").orderBy("distance", "neighbor")
    ranked = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    return ranked.select(F.col("_q").alias(key), "nth", "neighbor", "neighbor_label", "distance")


def knn_vote(neighbors: DataFrame, key: str, k: int, weights: str = "uniform") -> DataFrame:
    """Majority label of the first k neighbours; equal votes go to the lower label."""
    n = neighbors.where(F.col("nth") <= k)
    if weights == "distance":
        exact = F.count(F.when(F.col("distance") == 0, 1))
        weight = F.sum(F.when(F.col("distance") > 0, 1 / F.col("distance")))
        votes = n.groupBy(key, "neighbor_label").agg(exact.alias("_zero"), weight.alias("_w"))
        near = F.when(F.col("_zero") > 0, 0.0).otherwise(F.round(F.coalesce("_w", F.lit(0.0)), 9))
        order = F.struct(F.col("_zero"), near, -F.col("neighbor_label"))
    else:
        votes = n.groupBy(key, "neighbor_label").agg(F.count(F.lit(1)).alias("_w"))
        order = F.struct(F.col("_w"), -F.col("neighbor_label"))
    return votes.groupBy(key).agg(F.max_by("neighbor_label", order).alias("prediction"))
