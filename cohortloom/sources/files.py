"""File scans: inventory without contents, and permissive CSV streams as long samples."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.numeric import to_number

MIB = 1 << 20


def file_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Path, name, extension, folder, size and time of every file below ``root``; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("file_name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    )


def inventory_summary(inv: DataFrame, by: str, size: str, top: int = 15) -> DataFrame:
    """Count, bytes and MiB per group, largest groups first."""
    g = inv.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    return g.withColumn("mib", F.col("bytes") / MIB).orderBy(F.col("bytes").desc(), by).limit(top)


def read_stream_files(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str]) -> DataFrame:
    """CSV rows as text columns with their path; a row that does not fit keeps its text in ``_corrupt``.

    A file whose header has other names, or the same ones in another order, fails the read.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_corrupt", T.StringType())])
    reader = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("recursiveFileLookup", "true")
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(paths)
    return rows.select("*", F.col("_metadata.file_path").alias("path"))


def read_streams(spark: SparkSession, layouts: Mapping[str, tuple[str, Sequence[str]]], time_column: str, ids: Mapping[str, Column]) -> DataFrame:
    """Streams of different layouts as one long table: ids, stream, t, column, value.

    ``layouts`` maps a stream to (path, its columns); ``ids`` are expressions over ``path``.  Text
    that is no number reads as NULL, so one bad cell never drops its row.
    """
    parts = []
    for stream, (path, columns) in layouts.items():
        rows = read_stream_files(spark, path, columns)
        signal = [c for c in columns if c != time_column]
        numbers = rows.select(
            *[c.alias(n) for n, c in ids.items()], F.lit(stream).alias("stream"), to_number(F.col(time_column)).alias("t"),
            *[to_number(F.col(c)).alias(c) for c in signal],
        )
        parts.append(numbers.unpivot([*ids, "stream", "t"], signal, "column", "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file."""
    return spark.read.option("header", "true").csv(path).columns
