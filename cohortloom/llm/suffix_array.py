"""Suffix arrays by induced sorting, and permuted common prefixes.

At the byte level the inducing passes go bucket by bucket: all entries of a bucket that are known at a time induce their
left neighbours in one numpy step. The reduced string of the recursion has a large alphabet and is induced entry by entry.
"""
from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than their right neighbour, and the places of the leftmost of each run of such."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    smaller = np.zeros(n, bool)
    if len(differs):
        nearest = np.searchsorted(differs, np.arange(n - 1))
        known = nearest < len(differs)
        at = differs[np.minimum(nearest, len(differs) - 1)]
        smaller[:-1] = known & (s[at] < s[at + 1])
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, leftmost


def _induce_by_bucket(s: np.ndarray, smaller: np.ndarray, size: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n, k = len(s), len(size)
    first = np.zeros(k + 1, np.int64)
    np.cumsum(size, out=first[1:])
    sa = np.full(n, -1, np.int64)
    tail = first[1:].copy()
    of = s[lms]
    by_char = np.argsort(of, kind="stable")
    count = np.bincount(of, minlength=k)
    placed = np.concatenate([np.arange(first[c + 1] - count[c], first[c + 1]) for c in np.flatnonzero(count)]) if len(lms) else np.zeros(0, np.int64)
    sa[placed] = lms[by_char]

    def put(pred: np.ndarray, head: np.ndarray, step: int) -> None:
        char = s[pred]
        order = np.argsort(char, kind="stable")
        char, pred = char[order], pred[order]
        cut = np.flatnonzero(np.r_[True, char[1:] != char[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], len(char)]):
            c = char[a]
            if step > 0:
                sa[head[c] : head[c] + b - a] = pred[a:b]
                head[c] += b - a
            else:
                sa[head[c] - (b - a) : head[c]] = pred[a:b][::-1]
                head[c] -= b - a

    head = first[:-1].copy()
    put(np.array([n - 1]), head, 1)
    for c in range(k):
        done = first[c]
        while done < head[c]:  # larger suffixes of the bucket, which may induce more of them
            batch = sa[done : head[c]]
            done = head[c]
            pred = batch[batch > 0] - 1
            if len(pred := pred[~smaller[pred]]):
                put(pred, head, 1)
        batch = sa[first[c + 1] - count[c] : first[c + 1]] if count[c] else sa[:0]
        pred = batch[batch > 0] - 1
        if len(pred := pred[~smaller[pred]]):
            put(pred, head, 1)
    for c in range(k):  # the leftmost-smaller ones have done their work
        sa[head[c] : first[c + 1]] = -1
    for c in range(k - 1, -1, -1):
        done = first[c + 1]
        while done > tail[c]:
            batch = sa[tail[c] : done][::-1]
            done = tail[c]
            pred = batch[batch > 0] - 1
            if len(pred := pred[smaller[pred]]):
                put(pred, tail, -1)
        batch = sa[first[c] : head[c]][::-1]
        pred = batch[batch > 0] - 1
        if len(pred := pred[smaller[pred]]):
            put(pred, tail, -1)
    return sa


def _induce_by_entry(s: np.ndarray, smaller: np.ndarray, size: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(s)
    text, is_smaller = s.tolist(), smaller.tolist()
    ends = np.cumsum(size)
    sa, tail, head = [-1] * n, ends.tolist(), (ends - size).tolist()
    for i in reversed(lms.tolist()):
        c = text[i]
        tail[c] -= 1
        sa[tail[c]] = i
    c = text[n - 1]
    sa[head[c]] = n - 1
    head[c] += 1
    for r in range(n):
        i = sa[r] - 1
        if i >= 0 and not is_smaller[i]:
            c = text[i]
            sa[head[c]] = i
            head[c] += 1
    tail = ends.tolist()
    for r in range(n - 1, -1, -1):
        i = sa[r] - 1
        if i >= 0 and is_smaller[i]:
            c = text[i]
            tail[c] -= 1
            sa[tail[c]] = i
    return np.array(sa)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of an array of small non-negative integers, in sorted order; linear time."""
    s = np.asarray(s, np.int64)
    n = len(s)
    if n < 2:
        return np.arange(n)
    size = np.bincount(s)
    induce = _induce_by_bucket if len(size) <= 1024 else _induce_by_entry
    smaller, lms = _types(s)
    sa = induce(s, smaller, size, lms)
    if len(lms) < 2:
        return sa
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    stop = np.r_[lms[1:] + 1, n]  # a substring ends with the first byte of the next
    raw = s.astype(np.int64).tobytes()
    begin, end = ordered * 8, stop[number[ordered]] * 8
    new = np.ones(len(ordered), bool)
    same_length = np.flatnonzero((end[1:] - begin[1:]) == (end[:-1] - begin[:-1])) + 1
    last = lms[-1]
    for r in same_length.tolist():
        if ordered[r] != last and ordered[r - 1] != last and raw[begin[r] : end[r]] == raw[begin[r - 1] : end[r - 1]]:
            new[r] = False
    name = np.cumsum(new) - 1
    if name[-1] + 1 == len(lms):
        return induce(s, smaller, size, ordered)
    reduced = np.zeros(len(lms), np.int64)
    reduced[number[ordered]] = name
    return induce(s, smaller, size, lms[suffix_array(reduced)])


def common_prefixes(s: bytes | list[int], sa: np.ndarray, most: int) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one before it in sorted order, ``most`` at most."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out, length = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            length = 0
            continue
        limit = min(most, n - i, n - j)
        while length < limit and s[i + length] == s[j + length]:
            length += 1
        out[i] = length
        if length:
            length -= 1
    return np.array(out)
