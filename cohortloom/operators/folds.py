"""Group-isolated splits and their audits."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordered


def _fill(loads: np.ndarray, size: int, items: int) -> np.ndarray:
    """How many of ``items`` equal-sized groups each fold takes when each goes to the lightest fold."""
    def taken(level: int) -> np.ndarray:
        return np.maximum(0, -((loads - level) // size))

    lo, hi = int(loads.min()), int(loads.min()) + size * items + 1
    while lo < hi:  # highest level whose picks below it number at most ``items``
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if taken(mid).sum() <= items else (lo, mid - 1)
    counts = taken(lo)
    spare = items - int(counts.sum())
    at_level = np.flatnonzero(loads + counts * size == lo)[:spare]
    counts[at_level] += 1
    return counts


@F.pandas_udf(T.IntegerType())
def _fold_of(loads: pd.Series, size: pd.Series, position: pd.Series) -> pd.Series:
    out = []
    for start, s, p in zip(loads, size, position):
        start = np.asarray(start, dtype=np.int64)
        out.append(int((start + _fill(start, int(s), int(p) - 1) * int(s)).argmin()) + 1)
    return pd.Series(out, dtype="int32")


def group_kfold(df: DataFrame, group: str, k: int, within: Sequence[str] = (), fold: str = "fold") -> DataFrame:
    """Largest group first into the lightest fold; equal sizes in group order, equal loads to the lowest fold.

    Only the sizes matter to the greedy walk, so one task walks the distinct sizes (at most the
    square root of twice the rows) and keeps the loads each size starts from; every group then
    finds its own fold from its position among the groups of its size.
    """
    base, by = (df, list(within)) if within else (df.withColumn("_all", F.lit(0)), ["_all"])
    sizes = base.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_size"))
    placed = ordered.row_numbers(sizes, [*by, "_size"], [group], "_position")
    hist = sizes.groupBy(*by, "_size").agg(F.count(F.lit(1)).alias("_groups"))
    types = {f.name: f.dataType for f in hist.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in by] + [
        T.StructField("_size", T.LongType()), T.StructField("_loads", T.ArrayType(T.LongType()))
    ])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        loads, rows = np.zeros(k, dtype=np.int64), []
        for size, groups in pdf.sort_values("_size", ascending=False)[["_size", "_groups"]].itertuples(index=False):
            rows.append(loads.copy())
            loads += _fill(loads, int(size), int(groups)) * int(size)
        out = pdf.sort_values("_size", ascending=False)[[*by, "_size"]].reset_index(drop=True)
        return out.assign(_loads=[r.tolist() for r in rows])

    starts = hist.groupBy(*by).applyInPandas(walk, schema)
    j = ordered.key_join(placed, starts, [*by, "_size"])
    return j.select(*within, group, F.col("_size").alias("group_rows"), _fold_of("_loads", "_size", "_position").alias(fold))


def snake_folds(df: DataFrame, group: str, k: int, fold: str = "fold") -> DataFrame:
    """Near-balanced folds without a walk: sizes in descending order dealt 1..k, k..1, and so on."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows")).withColumn("_neg", -F.col("group_rows"))
    n = ordered.row_numbers(sizes, [], ["_neg", group], "_rn")
    at = F.pmod(F.col("_rn") - 1, F.lit(2 * k))
    return n.select(group, "group_rows", F.when(at < k, at + 1).otherwise(2 * k - at).cast("int").alias(fold))


def nested_folds(df: DataFrame, group: str, outer: str, k_outer: int, k_inner: int) -> DataFrame:
    """Inner folds inside every outer training set: rows of the other outer folds, split again by group."""
    others = F.filter(F.array(*[F.lit(i) for i in range(1, k_outer + 1)]), lambda f: f != F.col(outer))
    train = df.select(group, F.explode(others).alias("outer_fold"))
    return group_kfold(train, group, k_inner, ["outer_fold"], "inner_fold")


def _label_counts(label: str, labels: Sequence[int]) -> list[Column]:
    return [F.count(F.when(F.col(label) == c, 1)).alias(f"_c{c}") for c in labels]


def _complement(df: DataFrame, key: str, label: str, labels: Sequence[int]) -> DataFrame:
    """Per key: its own label counts and those of everything else (whole table minus own)."""
    own = df.groupBy(key).agg(*_label_counts(label, labels))
    total = df.agg(F.array(*[F.count(F.when(F.col(label) == c, 1)) for c in labels]).alias("t")).scalar()
    out = own.withColumn("_total", total)
    test = F.array(*[F.col(f"_c{c}") for c in labels])
    train = F.zip_with("_total", test, lambda t, o: t - o)

    def positive(a: Column) -> Column:
        return F.size(F.filter(a, lambda x: x > 0)).cast("long")

    def total_of(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    return out.select(
        key, total_of(test).alias("test_rows"), total_of(train).alias("train_rows"), positive(test).alias("test_classes"), positive(train).alias("train_classes")
    )


def leave_one_out(df: DataFrame, group: str, label: str, labels: Sequence[int], prefix: str = "LOSO") -> DataFrame:
    """One split per group. The training side is the whole minus the group, so no group x row table is built."""
    c = _complement(df, group, label, labels)
    return c.withColumn("split_id", F.concat(F.lit(f"{prefix}_"), F.col(group).cast("string")))


def split_audit(df: DataFrame, fold: str, group: str, label: str, labels: Sequence[int]) -> DataFrame:
    """Per fold: row counts, class cover, groups on each side and groups on both (must be 0)."""
    pairs = df.select(group, fold).distinct()
    spread = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("_folds"))
    per = ordered.key_join(pairs, spread, [group]).groupBy(fold).agg(
        F.count(F.lit(1)).alias("test_groups"), F.count(F.when(F.col("_folds") > 1, 1)).alias("overlap_groups")
    )
    groups = spread.agg(F.count(F.lit(1))).scalar()
    c = _complement(df, fold, label, labels)
    return c.join(per, fold).withColumn("train_groups", groups - F.col("test_groups") + F.col("overlap_groups"))


def run_matrix(conditions: DataFrame, dims: Mapping[str, Sequence]) -> DataFrame:
    """Every condition with every fixed option of the other dimensions, and an id per run."""
    out = conditions
    for name, options in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(o) for o in options])))
    return out.withColumn("run_id", F.concat_ws("|", *[F.col(c).cast("string") for c in out.columns]))
