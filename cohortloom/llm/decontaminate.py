"""Benchmark decontamination by winnowing, all inside Spark's own functions.

Documents and benchmark items become words; every ``GRAM`` consecutive words give a hash, and of every ``SPAN - GRAM + 1``
consecutive hashes the smallest is a fingerprint. Two texts that share ``SPAN`` words in a row therefore share the
fingerprint of that very span. Documents are joined with the benchmark by fingerprint; for those with a shared one, each
span is extended to its ``SPAN`` words and compared word by word with the benchmark's spans of the same fingerprint.

Items of fewer than ``SPAN`` words are one span of their own length; their fingerprint is the hash of all their words, and
documents are hashed at the (at most ``SPAN - 1``) lengths that occur.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.columns import let, lower_ascii, words
from cohortloom.llm.components import settled

SPAN = 13
GRAM = 4  # as ``four_gram_hashes`` makes them
#: Rows of at most this many go to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_ROW = ["_id", "_digest"]


def _pairs(a: Column, step: int, join) -> Column:
    """``join(a[i], a[i + step])`` for every i that has both."""
    n = F.size(a)
    left = F.slice(a, F.lit(1), F.greatest(n - step, F.lit(0)))
    right = F.slice(a, F.lit(step + 1), F.greatest(n - step, F.lit(0)))
    return F.zip_with(left, right, join)


def word_hashes(ws: Column) -> Column:
    """Hashes of the words; words that differ in the case of A-Z only have equal ones."""
    return F.transform(ws, lambda w: F.xxhash64(F.lower(w)))


def gram_hashes(h: Column, n: int) -> Column:
    """Hashes of n consecutive words, from the hashes of the words."""
    if n == 1:
        return h

    def one_more(g: Column) -> Column:
        count = F.greatest(F.size(h) - (n - 1), F.lit(0))
        return F.zip_with(F.slice(g, F.lit(1), count), F.slice(h, F.lit(n), count), lambda a, b: F.xxhash64(a, b))

    return let(gram_hashes(h, n - 1), one_more)


def four_gram_hashes(h: Column) -> Column:
    """Hashes of four consecutive words: pairs of pairs."""
    return let(_pairs(h, 1, lambda a, b: F.xxhash64(a, b)), lambda pairs: _pairs(pairs, 2, lambda a, b: F.xxhash64(a, b)))


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def fingerprints(h: Column) -> Column:
    """The smallest of ten consecutive hashes of four words, one for each span of 13 words, in order."""
    return let(
        four_gram_hashes(h),
        lambda g: let(
            _pairs(g, 1, _smaller),
            lambda m2: let(_pairs(m2, 2, _smaller), lambda m4: let(_pairs(m4, 4, _smaller), lambda m8: _pairs(m8, 2, _smaller))),
        ),
    )


def _sized(marks: Column, size: int) -> Column:
    return F.transform(marks, lambda x: F.struct(F.lit(size).alias("size"), x.alias("mark")))


def marks_of(ws: Column, short_sizes: list[int]) -> Column:
    """Distinct (size, mark) structs of a document: winnowed fingerprints, and hashes at each of the short lengths."""

    def of_hashes(h: Column) -> Column:
        kinds = [_sized(F.array_distinct(fingerprints(h)), SPAN)]
        kinds += [_sized(F.array_distinct(gram_hashes(h, n)), n) for n in short_sizes]
        return kinds[0] if len(kinds) == 1 else F.concat(*kinds)

    return let(word_hashes(ws), of_hashes)


def spans_of(ws: Column, short_sizes: list[int], exact_size: bool) -> Column:
    """(size, mark, start, span) structs: the spans of a text with their marks. With ``exact_size``, a text of fewer than
    ``SPAN`` words is one span of its own length and has no others (a benchmark item); else all lengths are listed."""

    def listed(marks: Column, size: int) -> Column:
        return F.transform(
            marks,
            lambda m, i: F.struct(F.lit(size).alias("size"), m.alias("mark"), i.alias("start"), F.array_join(F.slice(ws, i + 1, F.lit(size)), " ").alias("span")),
        )

    def of_hashes(h: Column) -> Column:
        kinds = [listed(fingerprints(h), SPAN)]
        for n in short_sizes:
            own = listed(gram_hashes(h, n), n)
            kinds.append(F.when(F.size(ws) == n, own).otherwise(F.slice(own, 1, 0)) if exact_size else own)
        return F.concat(*kinds)

    return let(word_hashes(ws), of_hashes)


def _digest() -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64("text", F.length("text"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("_digest")


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Per document: the id, n_words, n_hit (words inside an occurrence of a span), items (ids of the items with an
    occurring span, as strings in string order).

    Rows that repeat both id and text count once; an id with several texts, or a null id, has a row for each text. A null
    text has no words. Benchmark rows without words are never hit; a null item id makes hits but is not listed. Columns
    other than id and text are ignored on both sides.
    """
    text = F.col("text")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(lower_ascii(text)).alias("ws")).where(F.size("ws") > 0)
    lengths = items.where(F.size("ws") < SPAN).select(F.size("ws").alias("n")).distinct()
    short_sizes = sorted(r.n for r in lengths.collect())  # SPAN - 1 numbers at most
    item_spans = items.select("item", F.explode(spans_of(F.col("ws"), short_sizes, True)).alias("s")).select("item", "s.size", "s.mark", "s.span").distinct()
    item_spans = settled(item_spans)
    n_spans = item_spans.count()

    docs = documents.select(F.col(id_col).alias("_id"), _digest(), "text")
    marked = docs.select(*_ROW, words(text).alias("ws")).select(*_ROW, F.size("ws").cast("long").alias("n_words"), marks_of(F.col("ws"), short_sizes).alias("marks"))
    known = _maybe_broadcast(item_spans.select("size", "mark").distinct().withColumn("known", F.lit(True)), n_spans)
    exploded = marked.select(*_ROW, "n_words", F.explode_outer("marks").alias("m")).select(*_ROW, "n_words", "m.size", "m.mark")
    checked = exploded.join(known, ["size", "mark"], "left").groupBy(*_ROW, "n_words").agg(F.max("known").alias("shared"))
    checked = settled(checked)

    shared = checked.where("shared").select(*_ROW)
    n_shared = shared.count()
    same_row = [docs[c].eqNullSafe(shared[c]) for c in _ROW]
    suspects = docs.join(_maybe_broadcast(shared, n_shared), same_row, "left_semi").select(*_ROW, words(lower_ascii(text)).alias("ws"))
    doc_spans = suspects.select(*_ROW, F.explode(spans_of(F.col("ws"), short_sizes, False)).alias("s")).select(*_ROW, "s.*")
    distinct_spans = _maybe_broadcast(item_spans.select("size", "mark", "span").distinct(), n_spans)
    hits = settled(doc_spans.join(distinct_spans, ["size", "mark", "span"]).select(*_ROW, "size", "start", "mark", "span").distinct())

    by_start = Window.partitionBy(*_ROW).orderBy("start", "size")
    reach = F.coalesce(F.max(F.col("start") + F.col("size")).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new_words = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest(F.col("start"), reach))
    n_hit = hits.select(*_ROW, "start", "size").distinct().select(*_ROW, new_words.cast("long").alias("n")).groupBy(*_ROW).agg(F.sum("n").alias("n_hit"))
    occurring = hits.select(*_ROW, "size", "mark", "span").distinct().join(_maybe_broadcast(item_spans, n_spans), ["size", "mark", "span"])
    found = occurring.where("item IS NOT NULL").groupBy(*_ROW).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = found.withColumnsRenamed({"_id": "_id2", "_digest": "_digest2"})
    per_doc = n_hit.join(found, n_hit["_id"].eqNullSafe(found["_id2"]) & (n_hit["_digest"] == found["_digest2"]), "left").drop("_id2", "_digest2")
    per_doc = per_doc.withColumnsRenamed({"_id": "_id2", "_digest": "_digest2"})
    joined = checked.join(per_doc, checked["_id"].eqNullSafe(per_doc["_id2"]) & (checked["_digest"] == per_doc["_digest2"]), "left")
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "_digest",
    )


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """At least a twentieth of the words are hit, and at least one is."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with their columns; copies of a row share its fate.

    Contaminated (id, text digest) rows are few or many; they are broadcast only up to ``BROADCAST_ROWS``.
    """
    found = contamination(documents, benchmark, id_col).where(contaminated()).select(F.col(id_col).alias("_id"), "_digest")
    found = settled(found)
    out = _maybe_broadcast(found, found.count())
    return documents.join(out, documents[id_col].eqNullSafe(out["_id"]) & (_digest() == out["_digest"]), "left_anti")
