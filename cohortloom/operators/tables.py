"""Sorting, top-k, set and snapshot operators."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def stable_sort(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total order over the given keys (range-partitioned by Spark)."""
    return df.orderBy(*keys)


def shared_rank(df: DataFrame, keys: Sequence[str], criteria: Sequence[tuple[str, bool]], tie: str, tolerance: float = 1e-12) -> DataFrame:
    """Competition rank over a multi-criteria order; neighbours within ``tolerance`` on every criterion share it.

    Ranks a table of candidates (models, conditions), one row each.
    """
    order = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in criteria] + [F.col(tie)]
    w = Window.partitionBy(*keys).orderBy(*order)
    apart = reduce(lambda a, b: a | b, [F.abs(F.col(c) - F.lag(c).over(w)) > tolerance for c, _ in criteria])
    marked = df.withColumn("_pos", F.row_number().over(w)).withColumn("_new", F.when(F.coalesce(apart, F.lit(True)), F.col("_pos")))
    return marked.withColumn("rank", F.max("_new").over(w)).drop("_pos", "_new")


def rank_features(scores: DataFrame, keys: Sequence[str], score: str, position: str) -> DataFrame:
    """Rank by score, highest first, missing scores last; equal scores put the later column first."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(position).desc())
    return scores.withColumn("rank", F.row_number().over(w))


def select_top_k(scores: DataFrame, keys: Sequence[str], score: str, position: str, requests: Sequence[int | str]) -> DataFrame:
    """The first min(k, available) ranked features for each requested k ('all' keeps every one)."""
    ranked = rank_features(scores, keys, score, position)
    counted = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    asked = F.array(*[
        F.struct(F.lit(str(q)).alias("requested"), F.lit(None if q == "all" else int(q)).cast("long").alias("k")) for q in requests
    ])
    rows = counted.withColumn("_q", F.explode(asked))
    effective = F.least(F.coalesce(F.col("_q.k"), F.col("_n")), F.col("_n"))
    out = rows.select("*", F.col("_q.requested").alias("requested"), effective.alias("effective_k"))
    return out.where(F.col("rank") <= F.col("effective_k")).drop("_q", "_n")


def top_n(df: DataFrame, order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]).limit(n)


def ranked_comparison(df: DataFrame, value: str, ties: Sequence[str], higher_is_better: bool = True) -> DataFrame:
    """Order a table of candidates by one figure with the distance from the best; NULL figures come last.

    ``ties`` must make the order unique. Ranks are numbered in value ranges, so no task holds the whole table.
    """
    placed = df.withColumn("_gap", F.col(value).isNull()).withColumn("_place", -F.col(value) if higher_is_better else F.col(value))
    ranked = ordered.row_numbers(placed, [], ["_gap", "_place", *ties], "rank").drop("_gap", "_place")
    best = df.agg((F.max if higher_is_better else F.min)(value)).scalar()
    return ranked.withColumn("rank", F.col("rank").cast("int")).withColumn("from_best", F.col(value) - best)


def concat_unlike(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct key with the side that holds it; one grouped pass over both sides."""
    both = left.select(*keys, F.lit(1).alias("_s")).unionAll(right.select(*keys, F.lit(2).alias("_s")))
    g = both.groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
    return g.select(*keys, F.when(F.col("_s") == 3, "both").when(F.col("_s") == 1, "left_only").otherwise("right_only").alias("side"))


def group_cover(members: DataFrame, feature: str, group: str, catalog: DataFrame) -> DataFrame:
    """Disjointness and exact cover of feature groups over a catalog of distinct features."""
    g = members.select(feature, group).distinct().groupBy(feature).agg(F.count(F.lit(1)).alias("groups"))
    j = g.join(catalog.select(feature).withColumn("_known", F.lit(True)), feature, "full_outer")
    status = (
        F.when(F.col("groups").isNull(), "uncovered").when(F.col("_known").isNull(), "unknown").when(F.col("groups") > 1, "overlap").otherwise("ok")
    )
    return j.select(feature, F.coalesce("groups", F.lit(0)).alias("groups"), status.alias("status"))


def distinct_latest(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """One row per key: the one with the largest ``by`` (a grouped maximum, so copies combine before the shuffle)."""
    rest = [c for c in df.columns if c not in keys and c != by]
    return df.groupBy(*keys).agg(F.max(F.struct(by, *rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    a = before.select(*keys, F.col(digest).alias("_a"))
    b = after.select(*keys, F.col(digest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified").otherwise("same")
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def pending_units(manifest: DataFrame, done: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Work units without a finished output of the same digest."""
    return manifest.join(done.select(*keys, digest), [*keys, digest], "left_anti")


def pareto_front(df: DataFrame, keys: Sequence[str], cost: str, gain: str, level: str | None = None, tie: str = "id", rows_per_chunk: int | None = None) -> DataFrame:
    """Rows no other row beats: lower ``cost``, higher ``gain`` and, optionally, lower ``level``.

    A sweep by cost keeps the best gain met so far, so no pairs of rows are formed. ``level`` is a
    third cost with few distinct values (model bytes); a row then competes in the sweep of its own
    level and of every higher one.
    """
    work = df
    by = list(keys)
    if level:
        above = df.select(*keys, level).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set(level)).alias("_levels"))
        work = ordered.key_join(df, above, keys).withColumn(
            "_at", F.explode(F.filter("_levels", lambda x: x >= F.col(level)))
        ).drop("_levels")
        by = [*keys, "_at"]
    best = work.groupBy(*by, cost).agg(F.max(gain).alias("_top"))
    swept = ordered.running(best, by, [cost], {"_before": ("max", "_top")}, inclusive=False, rows_per_chunk=rows_per_chunk)
    j = ordered.key_join(work, swept, [*by, cost])
    beaten = F.coalesce(F.col("_before") >= F.col(gain), F.lit(False)) | (F.col("_top") > F.col(gain))
    if not level:
        return j.where(~beaten).select(*df.columns)
    # An equal (cost, gain) at a lower level also beats a row in its own level's sweep.
    low = work.groupBy(*by, cost, gain).agg(F.min(level).alias("_low"))
    j = ordered.key_join(j, low, [*by, cost, gain])
    return j.where((F.col("_at") == F.col(level)) & ~beaten & (F.col("_low") == F.col(level))).select(*df.columns)
