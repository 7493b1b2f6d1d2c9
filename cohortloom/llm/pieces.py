"""Cuts texts into pieces such that equal 100-byte strings fall into pieces of the same key.

Every window of ``WINDOW`` bytes has an anchor: of the ``WINDOW - GRAM + 1`` grams of ``GRAM`` bytes in it, the one with
the smallest hash (the leftmost of equal ones). Consecutive windows with one anchor make a piece, the bytes from the first
window's first to the last window's last: 168 at most. The anchor's hash depends on the window's bytes alone, so windows
that are equal lie in pieces with equal anchor hashes.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cohortloom.llm import textbytes

WINDOW = 100
GRAM = 32
ANCHORS = WINDOW - GRAM + 1


@dataclass
class Pieces:
    doc: np.ndarray
    start: np.ndarray  # in the text
    windows: np.ndarray
    anchor: np.ndarray  # hash of the anchor gram
    content: np.ndarray  # hash of all bytes of the piece

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(self.doc[at], self.start[at], self.windows[at], self.anchor[at], self.content[at])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the ``GRAM`` bytes from each place on."""
    h, power, size = textbytes.BYTE_CODES[data], textbytes.BASE, 1
    while size < GRAM:
        h = h[:-size] * power + h[size:]
        power, size = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), size * 2
    return h


def cut(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """The pieces of a slice of texts; texts shorter than a window have none."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return Pieces(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    grams = gram_hashes(data)
    bits = max(1, int(len(data)).bit_length())
    place_mask = np.uint64((1 << bits) - 1)
    packed = (textbytes.mix(grams) & ~place_mask) | np.arange(len(grams), dtype=np.uint64)
    least, size = packed, 1
    while size * 2 <= ANCHORS:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if ANCHORS > size:
        least = np.minimum(least[: len(least) - (ANCHORS - size)], least[ANCHORS - size :])
    place = (least & place_mask).astype(np.int64)  # one for each window of the slice
    inside = np.zeros(len(place) + 1, np.int32)  # windows that lie in one text
    first, last = offsets[:-1], offsets[1:] - WINDOW + 1
    ok = last > first
    np.add.at(inside, first[ok], 1)
    np.add.at(inside, last[ok], -1)
    inside = np.cumsum(inside[:-1]) > 0
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    heads_of_texts = first[ok]
    head[heads_of_texts] = True
    start = np.flatnonzero(head)
    stop = np.zeros(len(place) + 1, bool)
    stop[1:] = inside
    stop[1:-1] &= ~inside[1:] | head[1:]
    windows = np.flatnonzero(stop) - start
    doc = np.searchsorted(offsets, start, "right") - 1
    end = start + windows + WINDOW - 1
    content = windows.astype(np.uint64)
    for at in (start, start + GRAM, start + 2 * GRAM, end - 3 * GRAM, end - 2 * GRAM, end - GRAM):
        content = textbytes.mix(content * textbytes.BASE + grams[at])
    return Pieces(doc, start - offsets[doc], windows, textbytes.mix(grams[place[start]] + np.uint64(1)), content)
