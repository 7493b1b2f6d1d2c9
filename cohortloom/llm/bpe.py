"""Byte-pair encoding and decoding with a public word vocabulary.

A text is cut at the added tokens, normalised (NFC, lower case), split into contractions, letter runs, single digits
and runs of marks, and each piece becomes a doubly linked list of byte symbols, the last one carrying the word-end
mark. A heap of (rank, place) offers the pair to merge next; entries whose symbols have changed since are skipped.
Pieces repeat a lot, so a worker keeps the ids of the pieces it has met lately, in two generations of up to ``CACHE_CHARS``:
when the young one is full it becomes the old one, and pieces that are met again come back from there. This changes no
result.

Decoding looks up the vocabulary strings of the ids and concatenates them with a space between, as the file has no
decoder of its own.
"""
from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import textbytes

#: Characters of a generation of known pieces, with ten more for each piece; about 60 MB of a worker's memory for each million.
CACHE_CHARS = 700_000
#: Documents that are encoded and decoded together.
ROWS_AT_A_TIME = 2_048
#: Two ids, or a rank and an id, are packed in one number.
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """A vocabulary file: token strings, merge ranks and the tokens that are matched in raw text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = self.ids | self.added
        self.tokens = [""] * (max(strings.values()) + 1)
        for token, i in strings.items():
            self.tokens[i] = token
        self.merges: dict[int, int] = {}  # pair of ids in one number: rank and made id in one number
        for rank, pair in enumerate(spec["model"]["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[x] << ID_BITS | self.ids[y]] = rank << ID_BITS | self.ids[x + y]
        symbols = byte_symbols()
        self.inner = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.suffix] for s in symbols]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p)
        self.pieces = regex.compile(pattern).findall
        self.ascii_pieces = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\s\p{L}\p{N}", r" \t-\ra-z0-9")).findall
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else lambda text: [text]
        self.array = pa.array(self.tokens, pa.string())
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = CACHE_CHARS

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        heap = []
        for i in range(n - 1):
            if merge := merges.get(symbol[i] << ID_BITS | symbol[i + 1]):
                heap.append((merge >> ID_BITS) * n + i)
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j >= n or symbol[i] < 0:
                continue
            merge = merges.get(symbol[i] << ID_BITS | symbol[j])
            if merge is None or merge >> ID_BITS != rank:
                continue  # one of the two has been merged since
            made = merge & ID_MASK
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if merge := merges.get(made << ID_BITS | symbol[k]):
                    heapq.heappush(heap, (merge >> ID_BITS) * n + i)
            if (h := before[i]) >= 0 and (merge := merges.get(symbol[h] << ID_BITS | made)):
                heapq.heappush(heap, (merge >> ID_BITS) * n + h)
        return array("i", [s for s in symbol if s >= 0]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        out = []
        known = self.known
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append(array("i", [self.added[part]]).tobytes())
                continue
            part = normalised(part)
            pieces = self.ascii_pieces(part) if part.isascii() else self.pieces(part)
            for piece in set(pieces).difference(known):
                known[piece] = self.old.get(piece) or self.encode_piece(piece)
                self.room -= len(piece) + 10
            out.extend(map(known.__getitem__, pieces))
            if self.room < 0:
                self.old, self.known = known, {}
                known, self.room = self.known, CACHE_CHARS
        return b"".join(out)


def normalised(text: str) -> str:
    """NFC, then each character's own lower case (no rule for word ends)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: pa.Array, path: str) -> pa.Array:
    v = vocabulary(path)
    ids = [v.encode(text.as_py()) if text.is_valid else b"" for text in texts]
    ends = np.cumsum([0, *map(len, ids)]) // 4
    textbytes.give_back()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def decode_ids(ids: pa.Array, path: str) -> pa.Array:
    v = vocabulary(path)
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    strings = v.array.take(ids.flatten())
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), strings), " ")


def encode(text: str | Column, path: str) -> Column:
    """Token ids of a text column (an array of ints); a null or empty text has none."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return encode_texts(texts, path)

    return encoded(text)


def decode(ids: str | Column, path: str) -> Column:
    """Text of a column of token ids; null or no ids give the empty text."""

    @F.arrow_udf("string")
    def decoded(arrays: pa.Array) -> pa.Array:
        return decode_ids(arrays, path)

    return decoded(ids)


def _code(path: str):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                some = batch.slice(at, ROWS_AT_A_TIME)
                ids = encode_texts(some["text"], path)
                yield pa.RecordBatch.from_arrays([*some.columns, ids, decode_ids(ids, path)], names=[*some.schema.names, "ids", "decoded"])
        vocabulary.cache_clear()  # the worker lives on
        textbytes.give_back()

    return coded


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` with ids and decoded; every row once, repeated rows and null texts included.

    Columns of the input named ids or decoded are replaced. A task holds the vocabulary, the pieces it has met lately and
    ``ROWS_AT_A_TIME`` rows with their ids.
    """
    own = documents.drop("ids", "decoded")
    schema = T.StructType([*own.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return own.mapInArrow(_code(path), schema)
