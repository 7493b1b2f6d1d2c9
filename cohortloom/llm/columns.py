"""Column helpers for the operators that stay inside Spark's own functions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: digits, ASCII letters and everything beyond ASCII. The second form expects lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_WORD_LOWERED = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in the case they are written in; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def places(array: Column, holds: Callable[[Column], Column]) -> Column:
    """Places (from 0) of the elements for which ``holds`` is true, in order."""
    return F.filter(F.transform(array, lambda x, i: F.when(holds(x), i)), lambda i: i.isNotNull())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to clash with no column of ``df`` in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
