"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A column's texts lie one after another in a single buffer, so words, hashes and class lookups of a whole batch are a
few numpy passes. Batches are cut into slices of at most ``SLICE`` bytes (a longer text is a slice of its own), which
bounds the working arrays whatever the batch holds. Null texts count as empty.
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

_MIX = np.random.default_rng(20240917)
#: A random odd 64-bit value for each byte, and the odd base of the polynomial word hash.
BYTE_CODES = _MIX.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on between tasks, and others run beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each text in them (one more offset than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE, most: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of runs of texts: at most ``limit`` bytes together and ``most`` texts."""
    data, offsets = column_bytes(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(at + most, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


@dataclass
class Words:
    """Words of a slice: first byte, byte after the last, and number of the text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    doc_first: np.ndarray  # first word of each text, one more than texts
    codes: np.ndarray  # running sum of the byte codes times the powers of their places in the word

    def hashes(self) -> np.ndarray:
        return mix(self.codes[self.end] - self.codes[self.start] + (self.end - self.start).astype(np.uint64))

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word (of the whole word if it is shorter); equals that of a word of n bytes."""
        end = np.minimum(self.start + n, self.end)
        return mix(self.codes[end] - self.codes[self.start] + (end - self.start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``is_word[byte]`` holds; runs never cross texts."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    start = np.flatnonzero(first)
    ends_here = np.zeros(len(data) + 1, bool)
    ends_here[1:] = inside
    ends_here[1:-1] &= ~inside[1:] | first[1:]
    end = np.flatnonzero(ends_here)
    place = np.zeros(len(data), np.int64)
    if len(start):
        longest = int((end - start).max())
        own = np.repeat(start, end - start)
        place[inside] = np.flatnonzero(inside) - own
    else:
        longest = 0
    powers = np.ones(longest + 1, np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(longest, BASE, np.uint64))
    codes = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(inside, BYTE_CODES[data] * powers[place], np.uint64(0)), out=codes[1:])
    doc_first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(doc_first))
    return Words(start, end, doc, doc_first, codes)


def word_hash(word: bytes) -> int:
    """The hash that ``Words.hashes`` gives to this word."""
    data = np.frombuffer(word, np.uint8)
    return int(words(data, np.array([0, len(data)]), np.ones(256, bool)).hashes()[0]) if len(data) else 0


def runs_of(keep: str) -> np.ndarray:
    """Byte table of a word class: ``alnum`` (0-9, a-z, A-Z and all non-ASCII), ``letters`` or ``nonspace``."""
    byte = np.arange(256)
    if keep == "nonspace":
        return ~((byte == 32) | ((byte >= 9) & (byte <= 13)))
    letters = ((byte >= 97) & (byte <= 122)) | ((byte >= 65) & (byte <= 90)) | (byte >= 128)
    return letters | ((byte >= 48) & (byte <= 57)) if keep == "alnum" else letters


def ngram_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the number of the first word of each."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * BASE + h[k : len(h) - n + 1 + k])
    whole = np.flatnonzero(doc[: len(out)] == doc[n - 1 :])
    return out[whole], whole


def sums_by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)
