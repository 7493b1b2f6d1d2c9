"""Raw stream files of unlike layouts: each file's own header is read as data, its numbers by name.

The lines of all files are one text table. A first scan gives one row per file block (its line count and first line); from
it come the headers and the row numbers, so no raw line is sorted or numbered by a window. A second scan takes the lines
apart by Spark's CSV rules. Any number of layouts is read at the same cost.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.functions.names import clean_name
from cohortloom.functions.numeric import to_number
from cohortloom.operators import ordered

#: Header bytes up to which the layouts (one row per file block) are broadcast; beyond it they join by shuffle.
BROADCAST_HEADERS = 64 << 20

# Cleaned names of a time column; names that begin with time_ or end with _time count too.
TIME_NAMES = ["time", "time_dn", "timestamp", "processedtime", "processed_time"]


def lines(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Lines that hold text, of all files below ``root``: path, block (its first byte), value, id (grows within a block)."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    return rows.where(F.trim("value") != "").withColumn("id", F.monotonically_increasing_id())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of a file, whose lines come one after another: line count, first id and first line."""
    names = ["path", "block", "lines", "first_id", "first_line"]
    now: list | None = None
    for batch in batches:
        path, block = batch["path"], batch["block"]
        n = len(batch)
        if not n:
            continue
        turns = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1])).to_pylist() if n > 1 else []
        heads = [0, *[i + 1 for i, turned in enumerate(turns) if turned]]
        for a, b in zip(heads, [*heads[1:], n]):
            at = [path[a].as_py(), block[a].as_py()]
            if now and now[:2] == at:
                now[2] += b - a
                continue
            if now:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in now], names=names)
            now = [*at, b - a, batch["id"][a].as_py(), batch["value"][a].as_py()]
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in now], names=names)


def layouts(rows: DataFrame) -> DataFrame:
    """One row per file block of ``lines``: path, block, first_id, before (lines of earlier blocks), rows (data rows of the
    file) and names (its header; a nameless column is called Unnamed: n, n from 0)."""
    found = rows.mapInArrow(_blocks, "path string, block long, lines long, first_id long, first_line string")
    # a file has one block per 100 MB or so, so its window is short
    file = Window.partitionBy("path")
    upto = file.orderBy("block")
    header = F.regexp_replace(F.first("first_line").over(upto), "^\\uFEFF", "")
    placed = ordered.settle(found).select(
        "path", "block", "first_id", F.coalesce(F.sum("lines").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.sum("lines").over(file) - 1).alias("rows"), header.alias("header"),
    )
    placed = ordered.settle(placed)
    names = _fields("header", _width(placed))
    last = F.array_max(F.transform(names, lambda c, i: F.when(c.isNotNull(), i + 1)))
    named = F.transform(F.slice(names, 1, F.coalesce(last, F.lit(0))), lambda c, i: F.coalesce(c, F.concat(F.lit("Unnamed: "), i.cast("string"))))
    return placed.select("path", "block", "first_id", "before", "rows", named.alias("names"))


def _width(placed: DataFrame) -> int:
    """Columns of the widest file; commas within quotes may make it too high, which does no harm."""
    most = placed.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(","), F.lit(""))))).first()[0]
    return (most or 0) + 1


def _fields(line: str, width: int) -> Column:
    """The fields of a CSV line as ``width`` texts; missing and empty ones are NULL."""
    parsed = F.from_csv(F.col(line), ", ".join(f"c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    return F.get(F.transform(F.array(parsed), lambda p: F.array(*[p[f"c{i}"] for i in range(width)])), F.lit(0))


def is_time(name: Column) -> Column:
    """Does this column name say that the column holds the time?"""
    c = clean_name(name)
    return c.isin(TIME_NAMES) | c.endswith("_time") | c.startswith("time_")


def with_time_column(files: DataFrame) -> DataFrame:
    """``files`` (with ``names``) and time_at, the place of the first column that holds the time by its name, NULL without one."""
    places = F.filter(F.transform("names", lambda c, i: F.when(is_time(c), i)), lambda i: i.isNotNull())
    return files.withColumn("time_at", F.get(places, F.lit(0)))


def numbers(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Data rows of ``lines`` with their file's columns of ``files`` (layouts, perhaps fewer files and more columns).

    Adds row (from 0, in file order) and cells (one number per name; text that is no number is NULL, so one bad cell never
    drops its row; a short row has NULLs at its end, fields beyond the header are left out). A quoted field stays on its line.
    """
    size = files.agg(F.sum(F.length(F.concat_ws(",", "names")) + F.length("path")).alias("bytes"), F.max(F.size("names")).alias("width")).first()
    side = F.broadcast(files) if (size["bytes"] or 0) <= BROADCAST_HEADERS else files
    joined = rows.join(side, ["path", "block"]).withColumn("row", F.col("before") + F.col("id") - F.col("first_id") - 1).where("row >= 0")
    texts = F.slice(_fields("value", max(1, size["width"] or 1)), 1, F.size("names"))
    kept = [c for c in files.columns if c not in ("block", "first_id", "before")]
    return joined.select(*kept, "row", F.transform(texts, to_number).alias("cells"))


def monotone_share(rows: DataFrame) -> DataFrame:
    """(path, place, share) for the columns of ``numbers``: of the steps between neighbouring rows with a number in both, the share that does not fall.

    For files whose header names no time column: a clock has a share near 1 and few repeated values.
    """
    cells = rows.select("path", "row", F.posexplode("cells").alias("place", "value")).where("value IS NOT NULL")
    near = ordered.with_neighbor(cells, ["path", "place"], ["row"], {"_prev": "value"})
    step = F.when(F.col("_prev").isNotNull(), F.col("value") - F.col("_prev"))
    g = near.groupBy("path", "place").agg(F.avg((step >= 0).cast("double")).alias("share"), F.avg((step > 0).cast("double")).alias("rising"))
    return g.select("path", "place", "share", "rising")


def with_guessed_time(files: DataFrame, rows: DataFrame, least: float = 0.999) -> DataFrame:
    """``files`` whose time_at is filled, where no name says it, with the leftmost column that rises in ``least`` of its steps or more."""
    rising = monotone_share(rows).where(F.col("rising") >= least).groupBy("path").agg(F.min("place").alias("_guess"))
    return files.join(rising, "path", "left").withColumn("time_at", F.coalesce("time_at", "_guess")).drop("_guess")
