"""Table scans. Spark prunes columns and pushes filters into the Parquet reader."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df
