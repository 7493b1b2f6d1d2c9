"""Sinks. Spark's commit protocol makes a finished write appear as a whole; ``versions`` replaces tables as a whole."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sort: Sequence[str] = (), partition_by: Sequence[str] = (), mode: str = "overwrite", splits: int = 64) -> None:
    """Parquet with rows in a fixed order inside each file."""
    out = df
    if partition_by:
        # Rows of one partition value go to several tasks by a digest of the row, so a large value is not one task's work.
        out = out.repartition(*partition_by, F.pmod(F.xxhash64(*df.columns), F.lit(splits)))
    if sort:
        out = out.sortWithinPartitions(*partition_by, *sort) if partition_by else out.sort(*sort)
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_wide(long: DataFrame, keys: Sequence[str], feature: str, value: str, features: Sequence[str], path: str) -> None:
    """One CSV column per feature, one row per key."""
    pivot_wide(long, keys, feature, value, features).write.mode("overwrite").option("header", "true").csv(path)


def pivot_wide(long: DataFrame, keys: Sequence[str], feature: str, value: str, features: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).pivot(feature, list(features)).agg(F.first(value))
