"""Substring dedup by hashing units of text: of all equal units of a corpus, the first stays.

A text is cut behind the matches of a pattern, by default behind line feeds and behind sentence marks with white space, so
that a passage is found that begins or ends inside a line. A unit's normal form has A-Z in lower case and one space for
every run of white space, none at the ends. Units of fewer than ``least_words`` words repeat by chance and always stay;
0 makes every unit with a form count. Digests (SHA-256) of the normal forms are grouped over the whole corpus; the
occurrence with the smallest (id, text digest, unit number) stays and the others go, with the place and length they had in
the original text recorded.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.columns import lower_ascii
from cohortloom.llm.components import settled

#: Ends of units, as regular expressions.
SENTENCE, LINE, PARAGRAPH = r"([.!?][ \t]+|\n)", r"(\n)", r"(\n\n)"
LEAST_WORDS = 12
#: Put behind the end of a unit; where a text holds one itself, it counts as a space.
MARK = "\x1e"
_CUT_TYPE = pa.struct([("kept", pa.string()), ("removed", pa.list_(pa.struct([("number", pa.int32()), ("first", pa.int32()), ("length", pa.int32())])))])


def normal_form(unit: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(unit), r"[\x09-\x0D\x20]+", " "))


def units(text: str, end: str) -> Column:
    """The units of a text, end marks included; together they are as long as the text."""
    return F.split(F.regexp_replace(F.translate(F.col(text), MARK, " "), end, "$1" + MARK), MARK)


def without(text: str, lengths: str, gone: str) -> Column:
    """(kept, removed) of a text, from the lengths of its units and the numbers of those that go."""

    @F.arrow_udf("kept string, removed array<struct<number:int,first:int,length:int>>")
    def cut(texts: pa.Array, lengths: pa.Array, gone_units: pa.Array) -> pa.Array:
        out = []
        for text, sizes, gone in zip(texts.to_pylist(), lengths.to_pylist(), gone_units.to_pylist()):
            if not gone:
                out.append({"kept": text, "removed": []})
                continue
            first, kept, removed, gone = 0, [], [], set(gone)
            for number, size in enumerate(sizes):
                if number in gone:
                    removed.append({"number": number, "first": first, "length": size})
                else:
                    kept.append(text[first : first + size])
                first += size
            out.append({"kept": "".join(kept), "removed": removed})
        return pa.array(out, _CUT_TYPE)

    return cut(text, lengths, gone)


def text_digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def dedup_units(documents: DataFrame, id_col: str = "doc_id", end: str = SENTENCE, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per input row: id, text, n_units, kept (the text without its redundant units), removed (structs of number,
    first and length in characters of the original text, in order).

    Rows that repeat both id and text are one document and come back as often as they stand there. A null text counts as
    empty: one empty unit, which stays. Null ids come last in the order of places. Columns other than id and text are
    ignored. Only digests are grouped, and counts and first places are combined before the shuffle, so a unit of a third of
    all texts is no hot group.
    """
    docs = documents.select(F.col(id_col).alias("_id"), text_digest("text").alias("_digest"), F.coalesce("text", F.lit("")).alias("text"))
    cut = docs.select("_id", "_digest", F.posexplode(units("text", end)).alias("number", "unit"))
    formed = cut.select("_id", "_digest", "number", normal_form(F.col("unit")).alias("form"))
    counted = formed.where((F.col("form") != "") & (F.size(F.split("form", " ")) >= least_words))
    place = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_digest", "number")
    hashed = settled(counted.select(F.sha2(F.col("form").cast("binary"), 256).alias("unit_digest"), place.alias("place")))
    first = hashed.groupBy("unit_digest").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    repeated = first.where(F.col("first") != F.col("last")).select("unit_digest", "first")
    later = hashed.join(repeated, "unit_digest").where(F.col("place") != F.col("first")).select("place.*").distinct()
    gone = later.groupBy("_id", "_digest").agg(F.collect_list("number").alias("gone"))
    gone = gone.withColumnsRenamed({"_id": "_id2", "_digest": "_digest2"})
    joined = docs.join(gone, docs["_id"].eqNullSafe(gone["_id2"]) & (docs["_digest"] == gone["_digest2"]), "left")
    sized = joined.select("_id", "text", "gone", F.transform(units("text", end), F.length).alias("lengths"))
    result = sized.select("_id", "text", F.size("lengths").cast("long").alias("n_units"), without("text", "lengths", "gone").alias("c"))
    return result.select(F.col("_id").alias(id_col), "text", "n_units", "c.kept", "c.removed")
