"""Tables that are replaced as a whole: data first, then one manifest row that makes it the table.

A version's rows go to a fresh folder under ``data``. What was written is read back and counted, and last of all one row is
added under ``manifests``, which Spark's commit makes appear at once or not at all. Readers follow the newest manifest, so
they see the old table or the new one, and a job that dies in between leaves a folder that nobody refers to.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.operators.audit import table_hash

from . import sinks

_MANIFEST = "version long, folder string, rows long, files long, digest string, columns string"


def history(spark: SparkSession, path: str) -> DataFrame:
    """All manifest rows: version, folder, rows, files, digest, columns; none where nothing has been published."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifests/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def newest(spark: SparkSession, path: str, version: int | None = None) -> Row | None:
    """The manifest row of a version, by default the last; two writers at once leave two, of which one is always taken."""
    found = history(spark, path)
    found = found if version is None else found.where(F.col("version") == version)
    return found.orderBy(F.desc("version"), "folder").first()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as the newest manifest (or that of ``version``) names it."""
    row = newest(spark, path, version)
    if row is None:
        raise FileNotFoundError(f"nothing has been published at {path}" if version is None else f"{path} has no version {version}")
    return _stored(spark, path, row["folder"], row["columns"])


def _stored(spark: SparkSession, path: str, folder: str, columns: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(columns))
    return spark.read.schema(schema).parquet(f"{path}/data/{folder}").select(schema.names)


def _digest(df: DataFrame) -> str:
    return table_hash(df).select(F.to_json(F.struct("*"))).first()[0]


def publish(df: DataFrame, path: str, sort: Sequence[str] = (), partition_by: Sequence[str] = ()) -> int:
    """Replaces the table at ``path`` by ``df`` and returns the new version number (from 1). Older versions stay readable."""
    spark, folder, columns = df.sparkSession, uuid.uuid4().hex, df.schema.json()
    last = newest(spark, path)
    sinks.write_table(df, f"{path}/data/{folder}", sort, partition_by, mode="errorifexists")
    written = _stored(spark, path, folder, columns)
    version = (last["version"] if last else 0) + 1
    _announce(spark, path, (version, folder, written.count(), len(written.inputFiles()), _digest(written), columns))
    return version


def _announce(spark: SparkSession, path: str, manifest: tuple) -> None:
    rows = spark.createDataFrame([manifest], _MANIFEST).coalesce(1)
    rows.write.mode("errorifexists").json(f"{path}/manifests/{manifest[0]:010d}-{manifest[1]}")


def publish_once(df: DataFrame, path: str) -> str:
    """CREATED where nothing is published, REUSED for an equal table (by the order-free content hash), else refused."""
    known = newest(df.sparkSession, path)
    if known is None:
        publish(df, path)
        return "CREATED"
    if known["digest"] != _digest(df):
        raise ValueError(f"frozen table at {path} differs; refusing to overwrite")
    return "REUSED"
