"""Bounded training samples for the classifiers of this package."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash slots of the sampling rate.
SLOTS = 1 << 30


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids have none."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


def is_held_out(doc_id: str, modulus: int, rest: int) -> Column:
    """True for the rows that no label may be learnt from; a null id is not held out (and has no label)."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(False))


def bounded(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, picked by a hash of ``key``: all rows when there are no more than that.

    The share is ``bound`` over the number of rows, so the expected number is the bound at any size of the table.
    """
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(SLOTS)) < int(SLOTS * bound / n))


def bounded_by(rows: DataFrame, group: str, keys: list[str], bound: int, least: int) -> DataFrame:
    """About ``bound`` different rows at most, dealt over the values of ``group``: all when there are no more rows than that.

    Values with few rows keep them all, the others give the same expected number each, at least ``least``, so that no value
    is lost at any size; with very many values the bound gives way to that. Rows are picked by a hash of ``keys``; of rows
    that are equal in them, one is taken. The counts of the values reach the driver.
    """
    counts = {r[0]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) <= bound:
        return rows.dropDuplicates([group, *keys])
    left, cap = bound, 0
    ordered = sorted(counts.values())
    for i, n in enumerate(ordered):
        cap = left // (len(ordered) - i)
        if n > cap:
            break
        left -= n
    cap = max(cap, least)
    slots = [(value, min(SLOTS, -(-SLOTS * cap // n))) for value, n in counts.items()]
    rates = rows.sparkSession.createDataFrame(slots, f"_value {rows.schema[group].dataType.simpleString()}, _slots long")
    dealt = rows.join(F.broadcast(rates), F.col(group) == F.col("_value"))
    picked = dealt.where(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(SLOTS)) < F.col("_slots"))
    return picked.select(rows.columns).dropDuplicates([group, *keys])


def labelled_texts(documents: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Texts with their labels for about ``bound`` label rows.

    The picked label rows (at most a few times ``bound``) go to the documents, so that no text outside the sample moves.
    Several label rows of one id give several training rows.
    """
    picked = bounded(labels.where(F.col("doc_id").isNotNull()), "doc_id", bound)
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
