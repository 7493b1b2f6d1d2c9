"""Row-level stream operators: time base, cleaning, scored interval, layouts, anonymised ids."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def dedup_names(df: DataFrame, group: Sequence[str], name: str, position: str, out: str = "out_name") -> DataFrame:
    """Repeated names of a group become name__dup2, name__dup3 ... in column order."""
    numbered = ordered.row_numbers(df, [*group, name], [position], "_nth")
    suffixed = F.concat(F.col(name), F.lit("__dup"), F.col("_nth").cast("string"))
    return numbered.withColumn(out, F.when(F.col("_nth") > 1, suffixed).otherwise(F.col(name))).drop("_nth")


def time_base(df: DataFrame, keys: Sequence[str], raw: str, tie: str, is_datenum: Column) -> DataFrame:
    """Per run: first raw time, unit scale (days, ms or s), duration in s and sampling rate."""
    diffs = ordered.with_neighbor(df.select(*keys, raw, tie), keys, [raw, tie], {"_prev": raw}).withColumn(
        "_diff", F.col(raw) - F.col("_prev")
    )
    med = ordered.exact_quantiles(diffs, keys, "_diff", [0.5], "_med")
    base = df.groupBy(*keys).agg(
        F.min(raw).alias("t0"), F.max(raw).alias("_t1"), F.count(raw).alias("_n"), F.bool_or(is_datenum).alias("_dn")
    )
    joined = ordered.key_join(base, med, keys, "left")
    scale = (
        F.when(F.col("_dn") | (F.col("t0") > 100000), 86400.0).when(F.get("_med", F.lit(0)) > 1000, 0.001).otherwise(1.0)
    )
    dur = (F.col("_t1") - F.col("t0")) * scale
    usable = (F.col("_n") >= 2) & (F.col("_t1") > F.col("t0"))
    return joined.select(
        *keys, "t0", scale.alias("scale"), F.when(usable, dur).alias("duration"),
        F.when(usable, (F.col("_n") - 1) / dur).alias("sampling_rate"),
    )


def elapsed_seconds(df: DataFrame, keys: Sequence[str], raw: str, tie: str, is_datenum: Column) -> DataFrame:
    base = time_base(df, keys, raw, tie, is_datenum)
    return ordered.key_join(df, base.select(*keys, "t0", "scale"), keys).withColumn(
        "elapsed", (F.col(raw) - F.col("t0")) * F.col("scale")
    ).drop("t0", "scale")


def clean_stream(
    df: DataFrame, keys: Sequence[str], value_columns: Sequence[str], sentinels: Mapping[str, tuple[float, float]], min_rows: int = 50
) -> DataFrame:
    """Replace sentinel values, drop rows with a gap, drop streams that end up too short."""
    out = df
    for c, (bad, good) in sentinels.items():
        out = out.withColumn(c, F.when(F.col(c) == bad, F.lit(good)).otherwise(F.col(c)))
    out = out.dropna(subset=list(value_columns))
    long_enough = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return out.join(long_enough, list(keys), "left_semi")


def to_layout(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename and reorder to a standard layout: mapping of new name to old name."""
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()])


def scored_interval(df: DataFrame, keys: Sequence[str], order: Sequence[str], speed: str, low_enough: Column) -> DataFrame:
    """Rows from the sample before the first speed change to the last one where ``low_enough`` holds."""
    nxt = ordered.with_neighbor(df, keys, order, {"_next": speed}, offset=1)
    place = ordered.order_key(*order)
    span = nxt.groupBy(*keys).agg(
        F.min(F.when(F.col("_next") != F.col(speed), place)).alias("_from"), F.max(F.when(low_enough, place)).alias("_to")
    )
    joined = ordered.key_join(df, span, keys)
    return joined.where((place >= F.col("_from")) & (place <= F.col("_to"))).drop("_from", "_to")


def anonymize(df: DataFrame, order: Sequence[str], drop: Sequence[str], prefix: str = "DEMO", out: str = "demo_id") -> DataFrame:
    """Running ids in key order; the identifying columns are dropped."""
    numbered = ordered.row_numbers(df, [], order, "_nth")
    return numbered.withColumn(out, F.format_string(f"{prefix}-%04d", "_nth")).drop("_nth", *drop)
