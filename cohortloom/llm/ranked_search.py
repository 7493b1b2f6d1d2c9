"""Ranked search of items in documents by dense blocked multiplication.

The terms of the items are numbered densely; a document is a row of term impacts, an item a column of term weights, and all
scores of a tile of documents and a tile of items are products of float64 matrices. All numbers are integers: a tile of
terms is so narrow that no partial sum reaches 2^53, so every product is exact, and tiles are added up as 64-bit integers.

Two passes over the documents: the first counts documents, terms and the documents that hold each item term; the second
scores. A task keeps the best ``k`` documents of each item with all ties settled by (score, id), so what leaves it does not
grow with its rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import textbytes
from cohortloom.llm.components import settled

K = 10
#: Documents, terms and items of a tile, at most; a term tile is narrower when sums could pass EXACT.
DOC_TILE, TERM_TILE, ITEM_TILE = 1_024, 2_048, 1_024
EXACT = 1 << 53
#: An impact is below 10^9 / 10^3.
IMPACT_BOUND = 1_000_000
#: Bytes of item texts that are sent to all tasks at once; more items go in several passes.
ITEM_BYTES = 16 << 20
#: First ranks are taken in so many parts of the documents.
PARTS = 64

_TERM = textbytes.runs_of("alnum")


@dataclass
class Items:
    """A set of items: sorted hashes of their terms, and which terms each item holds (once each)."""

    hashes: np.ndarray
    first: np.ndarray  # first place of each item in ``terms``, one more than items
    terms: np.ndarray  # term numbers

    def __len__(self) -> int:
        return len(self.first) - 1


def items_of(texts: list[str | None]) -> Items:
    per_item = [np.zeros(0, np.uint64)] * len(texts)
    for at, data, offsets in textbytes.slices(pa.array(texts, pa.string())):
        w = textbytes.words(textbytes.fold_case(data), offsets, _TERM)
        h = w.hashes()
        for i in range(len(offsets) - 1):
            per_item[at + i] = np.unique(h[w.doc_first[i] : w.doc_first[i + 1]])
    everything = np.concatenate([np.zeros(0, np.uint64), *per_item])
    hashes = np.unique(everything)
    return Items(hashes, np.cumsum([0, *map(len, per_item)]), np.searchsorted(hashes, everything))


def term_counts(items: Items, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per document, and (document, item term, occurrences) of the item terms, ordered by document and term."""
    w = textbytes.words(textbytes.fold_case(data), offsets, _TERM)
    lengths = np.diff(w.doc_first).astype(np.int64)
    h = w.hashes()
    if not len(items.hashes):
        h = h[:0]
    place = np.minimum(np.searchsorted(items.hashes, h), max(len(items.hashes) - 1, 0))
    met = np.flatnonzero(items.hashes[place] == h) if len(h) else np.zeros(0, np.int64)
    pair, tf = np.unique(w.doc[met] * np.int64(max(len(items.hashes), 1)) + place[met], return_counts=True)
    doc, term = np.divmod(pair, max(len(items.hashes), 1))
    return lengths, doc, term, tf.astype(np.int64)


def _count(items: Items):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, total = np.zeros(len(items.hashes), np.int64), 0, 0
        for batch in batches:
            for _, data, offsets in textbytes.slices(batch["text"]):
                lengths, _, term, _ = term_counts(items, data, offsets)
                held += np.bincount(term, minlength=len(held))
                docs, total = docs + int((lengths > 0).sum()), total + int(lengths.sum())
        some = np.flatnonzero(held)
        yield pa.record_batch({"term": np.r_[[-2, -1], some], "n": np.r_[[docs, total], held[some]].astype(np.int64)})

    return count


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term, in doubles."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)


def impacts(tf: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = 100 - 90 + (90 * lengths * documents) // max(total, 1)
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


class Best:
    """The k best (score, id) of each item so far; equal scores go to the smaller id, a null id comes last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item = np.zeros(0, np.int64)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]  # score, id, id is null
        self.least = np.ones(items, np.int64)

    def offer(self, scores: np.ndarray, first_item: int, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores of documents (rows) and items (columns, from ``first_item``); rows that tie with the k-th best are kept."""
        doc, item = np.nonzero(scores >= self.least[first_item : first_item + scores.shape[1]])
        if not len(doc):
            return
        self.item = np.concatenate([self.item, item + first_item])
        self.rows = [np.concatenate(pair) for pair in zip(self.rows, (scores[doc, item], ids[doc], null[doc]))]
        score, own, absent = self.rows
        order = np.lexsort((own, absent, -score, self.item))
        grouped = self.item[order]
        begins = np.searchsorted(grouped, np.arange(len(self.least)))
        rank = np.arange(len(order)) - begins[grouped]
        kept = order[rank < self.k]
        self.item, self.rows = self.item[kept], [r[kept] for r in self.rows]
        full = order[rank == self.k - 1]
        self.least[grouped[rank == self.k - 1]] = score[full]


def _score(items: Items, weight: np.ndarray, documents: int, total: int, k: int):
    width = max(1, min(TERM_TILE, (EXACT - 1) // (max(int(weight.max(initial=0)), 1) * IMPACT_BOUND)))

    order = np.argsort(items.terms, kind="stable")
    holders = np.repeat(np.arange(len(items)), np.diff(items.first))[order]  # items of each term, term by term
    first = np.searchsorted(items.terms[order], np.arange(len(items.hashes) + 1))

    def side(terms: np.ndarray, at: int, end: int) -> np.ndarray:
        """Weights of some terms (rows) in a tile of items (columns)."""
        sizes = first[terms + 1] - first[terms]
        row = np.repeat(np.arange(len(terms)), sizes)
        item = holders[np.arange(len(row)) + np.repeat(first[terms] - np.cumsum(sizes) + sizes, sizes)]
        here = (item >= at) & (item < end)
        out = np.zeros((len(terms), end - at))
        out[row[here], item[here] - at] = weight[terms[row[here]]]
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        for batch in batches:
            ids, null = batch["doc_id"].fill_null(0).to_numpy(), batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            for first, data, offsets in textbytes.slices(batch["text"], most=DOC_TILE):
                lengths, doc, term, tf = term_counts(items, data, offsets)
                if not len(doc):
                    continue
                value = impacts(tf, lengths[doc], documents, total)
                own, null_own = ids[first : first + len(lengths)], null[first : first + len(lengths)]
                present, column = np.unique(term, return_inverse=True)  # the compact vocabulary of the tile
                dense = np.zeros((len(lengths), len(present)))
                dense[doc, column] = value
                for at in range(0, len(items), ITEM_TILE):
                    end = min(at + ITEM_TILE, len(items))
                    sums = np.zeros((len(lengths), end - at), np.int64)
                    for t in range(0, len(present), width):
                        sums += (dense[:, t : t + width] @ side(present[t : t + width], at, end)).astype(np.int64)
                    best.offer(sums, at, own, null_own)
        score, own, absent = best.rows
        yield pa.record_batch({"item": best.item, "doc_id": pa.array(own, mask=absent), "score": score})

    return score


def _chunks(items: DataFrame, limit: int) -> list[DataFrame]:
    """The items in parts whose texts are proven to take ``limit`` bytes at most (or to be a single item)."""
    parts = 1
    while True:
        dealt = items.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
        sizes = dealt.groupBy("_part").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64).alias("bytes"), F.count(F.lit(1)).alias("n")).agg(F.max(F.when(F.col("n") > 1, F.col("bytes"))).alias("most")).first()
        if (sizes["most"] or 0) <= limit:
            return [dealt.where(F.col("_part") == p).drop("_part") for p in range(parts)]
        parts *= 2


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best per item, first in parts of the documents, then of all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    parts = Window.partitionBy("item", "part").orderBy(*order)
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k)
    whole = Window.partitionBy("item").orderBy(*order)
    return some.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).drop("part")


def search(documents: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k best documents with a score above 0 for every item: item_id, rank (from 1), doc_id, score.

    ``documents`` needs doc_id (a whole number) and text, ``items`` item_id and text; other columns are ignored. A null or
    empty text has no terms: such a document is never found, such an item finds nothing. Equal scores go to the smaller id,
    null ids last. Repeated documents are ranked one by one; items that repeat both id and text count once, others with an
    equal id keep their own ranks. Terms are told apart by 64-bit hashes. An empty table on either side gives no rows.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = settled(items.select("item_id", "text").distinct())
    out = []
    for part in _chunks(asked, item_bytes):
        rows = part.collect()
        terms = items_of([r["text"] for r in rows])
        counts = {r["term"]: r["n"] for r in documents.select("text").mapInArrow(_count(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, total = counts.get(-2, 0), counts.get(-1, 0)
        held = np.array([counts.get(t, 0) for t in range(len(terms.hashes))], np.int64)
        found = documents.mapInArrow(_score(terms, weights(n, held), n, total, k), "item long, doc_id long, score long")
        schema = T.StructType([T.StructField("number", T.LongType()), asked.schema["item_id"]])
        names = documents.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], schema)
        ranked = _ranked(found, k).join(F.broadcast(names), F.col("item") == F.col("number"))
        out.append(ranked.select("item_id", "rank", "doc_id", "score"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
