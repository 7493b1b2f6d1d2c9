"""Ordered work per key (lag, running totals, ranks, quantiles) that survives hot keys.

A plain ``Window.partitionBy(key)`` or ``percentile`` gathers one key in one task.  Here a key with
more than about ``rows_per_chunk`` rows is cut into consecutive value ranges ("chunks"): the window
runs inside a chunk and a table with one row per chunk carries the state across.  Chunk bounds come
from a hash-picked sample, so every attempt of a task derives the same bounds.  Keys below the limit
have a NULL chunk and take no part in the carry join.  The plan is the same for every input size;
only the rows of a key decide whether it is cut.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom import session

ROWS_PER_CHUNK = 4_000_000
POINTS_PER_CHUNK = 8  # sampled rows per chunk: a trillion-row key samples about two million
MIN_ROW_BYTES = 4  # stored bytes per row at the least, to bound the row count by the input size
BOUND_BYTES = 40  # one bound: an order value and its tie-breaker
BROADCAST_LIMIT = 256 << 20
_ALL = "_all_rows"


def input_bytes(df: DataFrame) -> int:
    """Total size of the files and relations a plan reads, from the optimizer's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def _bounds_fit(df: DataFrame, limit: int) -> bool:
    """Can the chunk bounds be broadcast? They number one per ``limit`` rows, rows counted high."""
    return input_bytes(df) / MIN_ROW_BYTES / limit * BOUND_BYTES <= BROADCAST_LIMIT


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also pairs NULL keys and keeps one copy of each key column."""
    if not keys:  # one row on each side
        return left.withColumn(_ALL, F.lit(0)).join(right.withColumn(_ALL, F.lit(0)), _ALL, how).drop(_ALL)
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder before another ordered step.

    An ordered step reads its input for the bounds, the rows and the carried states; stacked steps would multiply that.
    """
    session.checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def _position(bounds: Column, value: Column, steps: int) -> Column:
    """Number of bounds <= value, by binary search."""
    def probe(found: Column, power: Column) -> Column:
        nxt = found + power
        fits = (nxt <= F.size(bounds)) & (F.element_at(bounds, F.least(nxt, F.size(bounds))) <= value)
        return F.when(F.coalesce(fits, F.lit(False)), nxt).otherwise(found)

    powers = F.array(*[F.lit(1 << s) for s in range(steps, -1, -1)])
    first = steps - F.floor(F.log2(F.size(bounds))).cast("int") + 1  # start at the largest power within the array
    return F.aggregate(F.slice(powers, first, steps + 1), F.lit(0), probe)


def range_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_chunk: int | None = None, hot_only: bool = False
) -> DataFrame:
    """Add ``_chunk``: ascending range number within a hot key, NULL for every other key.

    ``hot_only`` leaves out the rows of other keys; where there is no hot key, the adaptive plan then skips the rows.
    """
    limit = rows_per_chunk or ROWS_PER_CHUNK
    value = F.struct(*order) if len(order) > 1 else F.col(order[0])
    unit = F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 31)) / F.lit(float(1 << 31))
    sampled = df.select(*keys, *[c for c in order if c not in keys]).where(unit < F.lit(POINTS_PER_CHUNK / limit))
    points = sampled.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_points"))
    bounds = points.select(
        *keys, F.filter("_points", lambda x, i: i % POINTS_PER_CHUNK == POINTS_PER_CHUNK - 1).alias("_bounds")
    ).where(F.size("_bounds") > 0)
    chunk = F.when(F.col("_bounds").isNotNull(), _position(F.col("_bounds"), value, 22))
    if list(keys) == [_ALL]:  # one bounds array for the whole table: no join, so no shuffle on a constant key
        marked = df.withColumn("_bounds", bounds.select("_bounds").scalar())
        return (marked.where(F.col("_bounds").isNotNull()) if hot_only else marked).withColumn("_chunk", chunk).drop("_bounds")
    if _bounds_fit(df, limit):  # size checked; otherwise a shuffled join with adaptive skew splitting
        bounds = F.broadcast(bounds)
    return df.join(bounds, list(keys), "inner" if hot_only else "left").withColumn("_chunk", chunk).drop("_bounds")


def with_neighbors(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: Mapping[str, str | Column],
    after: Mapping[str, str | Column],
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Add columns of the previous row (``before``) and of the next (``after``); ``order`` must be unique per key."""
    base, by = _keyed(df, keys)
    place = F.struct(*order)
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    across = Window.partitionBy(*by).orderBy("_chunk")
    sides = [side for side in (("_before", before, F.lag, F.max_by), ("_after", after, F.lead, F.min_by)) if side[1]]

    def packed(rows: DataFrame) -> DataFrame:
        for side, columns, _, _ in sides:
            rows = rows.withColumn(side, F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]))
        return rows

    edges = packed(range_chunks(base, by, order, rows_per_chunk, hot_only=True)).groupBy(*by, "_chunk").agg(
        *[edge(side, place).alias(side) for side, _, _, edge in sides]
    )
    carry = edges.select(*by, "_chunk", *[step(side).over(across).alias(f"{side}_carried") for side, _, step, _ in sides])
    rows = packed(range_chunks(base, by, order, rows_per_chunk))
    near = rows.select(*base.columns, "_chunk", *[step(side).over(inside).alias(side) for side, _, step, _ in sides])
    joined = near.join(carry, [*by, "_chunk"], "left")
    return joined.select(*df.columns, *[
        F.coalesce(side, f"{side}_carried")[n].alias(n) for side, columns, _, _ in sides for n in columns
    ])


def with_neighbor(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str | Column],
    offset: int = -1,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Add the previous (offset -1) or next (+1) row's columns; ``order`` must be unique per key."""
    before, after = (columns, {}) if offset < 0 else ({}, columns)
    return with_neighbors(df, keys, order, before, after, rows_per_chunk)


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, tuple[str, str | Column]],
    inclusive: bool = True,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``last`` (last non-NULL) in order.

    ``inclusive=False`` leaves the current row out (NULL, or 0 for sums, on the first row).
    """
    base, by = _keyed(df, keys)
    for n, (_, c) in columns.items():
        base = base.withColumn(f"_in_{n}", F.col(c) if isinstance(c, str) else c)
    last_row = Window.currentRow if inclusive else -1
    chunks = range_chunks(base, by, order, rows_per_chunk)
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, last_row)
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)

    def chunk_total(n: str, kind: str) -> Column:
        c = F.col(f"_in_{n}")
        return F.max_by(c, F.when(c.isNotNull(), place)) if kind == "last" else _MERGE[kind](c)

    totals = range_chunks(base, by, order, rows_per_chunk, hot_only=True).groupBy(*by, "_chunk").agg(
        *[chunk_total(n, kind).alias(f"_t_{n}") for n, (kind, _) in columns.items()]
    )
    carry = totals.select(
        *by, "_chunk", *[_MERGE[kind](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (kind, _) in columns.items()]
    )
    out = chunks
    for n, (kind, _) in columns.items():
        out = out.withColumn(f"_w_{n}", _MERGE[kind](F.col(f"_in_{n}")).over(inside))
    out = out.join(carry, [*by, "_chunk"], "left")
    merged = []
    for n, (kind, _) in columns.items():
        w, c = F.col(f"_w_{n}"), F.col(f"_c_{n}")
        if kind == "sum":
            v = F.coalesce(w, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif kind == "last":
            v = F.coalesce(w, c)
        else:
            v = (F.greatest if kind == "max" else F.least)(w, c)
        merged.append(v.alias(n))
    return out.select(*df.columns, *merged)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", rows_per_chunk: int | None = None
) -> DataFrame:
    """1-based row number per key (the whole table when ``keys`` is empty)."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, rows_per_chunk=rows_per_chunk)


#: Times nearer to 0 than two to the minus this count as 0 in ``order_key``, times beyond two to this as equal.
EXPONENTS = 500


def order_key(t: str, tie: str) -> Column:
    """Time and tie-breaker as one decimal, for ``min_by`` / ``max_by`` over raw rows, in the order of (t, tie).

    A struct would do, but its aggregation buffer cannot be updated in place, so Spark would sort
    every raw row before the first aggregation; a decimal keeps it a hash aggregation. A time is
    taken apart into exponent and mantissa, which together order as the time does: no digit is
    lost, whatever its unit. The tie-breaker is a whole number of 18 digits at most.
    """
    far = 2.0**EXPONENTS
    size = F.least(F.abs(F.col(t).cast("double")), F.lit(far))
    guess = F.floor(F.log2(F.greatest(size, F.lit(1 / far))))
    scaled = size / F.pow(F.lit(2.0), guess)  # 1 up to 2, but for a logarithm that was rounded to the next whole number
    step = F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
    mantissa = F.when(scaled >= 2, scaled / 2).when(scaled < 1, scaled * 2).otherwise(scaled)
    bits = F.lit(1 << 52)
    place = (guess + step + EXPONENTS + 1).cast("long") * bits + ((mantissa - 1) * bits.cast("double")).cast("long")
    place = F.when(size < 1 / far, F.lit(0).cast("long")).otherwise(place)
    signed = F.when(F.col(t) < 0, -place).otherwise(place).cast("decimal(19,0)")
    return (signed * F.lit("10000000000000000000").cast("decimal(20,0)")).cast("decimal(38,0)") + F.col(tie).cast("decimal(19,0)")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank", rows_per_chunk: int | None = None
) -> DataFrame:
    """One row per (key, value) with ``_count`` and the tie-averaged rank of that value."""
    counts = value_counts(df, keys, value)
    below = running(counts, keys, [value], {"_below": ("sum", "_count")}, inclusive=False, rows_per_chunk=rows_per_chunk)
    return below.withColumn(name, F.col("_below") + (F.col("_count") + 1) / 2.0).drop("_below")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    name: str = "quantiles",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key as an array; NULL values are left out.

    Values are folded into counts before the shuffle; running totals of the counts place each quantile, so that no
    task holds the values of a key.
    """
    base, by = _keyed(df, keys)
    rows = base.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    counts = value_counts(rows, by, "_v")
    sizes = counts.groupBy(*by).agg(F.sum("_count").alias("_n"))
    placed = running(counts, by, ["_v"], {"_below": ("sum", "_count")}, inclusive=False, rows_per_chunk=rows_per_chunk)
    placed = key_join(placed, sizes, by)
    picks, blends = [], []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_count"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{tag}{i}"))
        part = pos - F.floor(pos)
        blends.append(F.when(part > 0, F.col(f"_lo{i}") * (1 - part) + F.col(f"_hi{i}") * part).otherwise(F.col(f"_lo{i}")))
    return placed.groupBy(*by, "_n").agg(*picks).select(*keys, F.array(*blends).alias(name))
