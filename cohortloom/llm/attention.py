"""A small causal self-attention model over subword symbols, in numpy.

A symbol looks back with one query over the symbols of its window: the weight of an earlier one is a product of a query and a
key, plus a learnt number for the distance between the two. What comes back is turned into class scores, beside the scores
that the symbol has on its own. Symbols are the most frequent subwords and one for all others; classes are the most frequent
subwords, buckets of the others, and the end. Inside a bucket, a subword has the share that it has in the training corpus.

Texts are scored in overlapping windows of ``WINDOW`` symbols, ``STRIDE`` apart: the last ``STRIDE`` places of a window are
scored, so every subword is scored once, with ``WINDOW - STRIDE`` symbols before it at least (where the text has them).
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE = 48, 24
LEAD = WINDOW - STRIDE
WIDTH = 16
#: Subwords that are symbols, or classes, of their own; buckets of the other subwords.
OWN_SYMBOLS, OWN_CLASSES, BUCKETS = 1_024, 63, 32
CLASSES = OWN_CLASSES + BUCKETS + 1
END = CLASSES - 1
OTHER, START, PAD = OWN_SYMBOLS, OWN_SYMBOLS + 1, OWN_SYMBOLS + 2
SYMBOLS = OWN_SYMBOLS + 3
FAR = np.float32(-1e9)
#: Windows that are worked on together.
BLOCK = 64
#: Sums of exponentials outside of this range are taken again from shifted exponents.
LEAST, MOST = 1e-20, 1e20
#: Step length of training.
RATE = 0.15

_SHAPES = {"query": (SYMBOLS, WIDTH), "key": (SYMBOLS, WIDTH), "value": (SYMBOLS, WIDTH), "out": (WIDTH, CLASSES), "own": (SYMBOLS, CLASSES), "distance": (WINDOW,)}


@dataclass
class Subwords:
    """What is known of each subword: its symbol, its class, and log10 of its share in its class."""

    symbol: np.ndarray
    kind: np.ndarray
    share: np.ndarray
    prior: np.ndarray  # natural log of the share of each class in the training corpus


def subwords(counts: np.ndarray, ends: int) -> Subwords:
    """Symbols, classes and shares from the training counts of all subwords (one is added to each) and of text ends."""
    n = counts.astype(np.float64) + 1
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((np.arange(len(n)), -counts))] = np.arange(len(n))
    symbol = np.where(rank < OWN_SYMBOLS, rank, OTHER)
    # the other subwords are cut by rank into buckets of about equal mass
    rest = np.flatnonzero(rank >= OWN_CLASSES)
    rest = rest[np.argsort(rank[rest])]
    mass = np.cumsum(n[rest])
    kind = rank.copy()
    if len(rest):
        kind[rest] = OWN_CLASSES + np.minimum((BUCKETS * (mass - n[rest] / 2) / mass[-1]).astype(np.int64), BUCKETS - 1)
    total = np.bincount(kind, weights=n, minlength=CLASSES)
    share = np.log10(n / total[kind])
    total[END] = ends + 1
    return Subwords(symbol.astype(np.int16), kind.astype(np.int8), share, np.log(np.maximum(total, 1e-3) / total.sum()).astype(np.float32))


def fresh(prior: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {name: rng.normal(0, 0.1, shape).astype(np.float32) for name, shape in _SHAPES.items()}
    w["own"] = np.tile(prior, (SYMBOLS, 1))
    w["distance"] = np.zeros(WINDOW, np.float32)
    return w


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[name].ravel() for name in _SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = np.asarray(values[at : at + n], np.float32).reshape(shape)
        at += n
    return out


_BACK = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]


def _mask(distance: np.ndarray, first: int) -> np.ndarray:
    """Numbers added to the products of the queries from place ``first`` on: by distance, and none ahead."""
    back = _BACK[first:]
    return np.where(back >= 0, distance[np.maximum(back, 0)], FAR).astype(np.float32)


def _kept(room: dict[str, np.ndarray], name: str, shape: tuple[int, ...], dtype) -> np.ndarray:
    """An array to write into, the same one for every block of a shape: fresh memory costs more than the work in it."""
    if name not in room or room[name].shape != shape:
        room[name] = np.empty(shape, dtype)
    return room[name]


def _joined(w: dict[str, np.ndarray]) -> np.ndarray:
    """Query, key and value of each symbol and a one, side by side: the one adds up weights in the product with the values."""
    return np.concatenate([w["query"], w["key"], w["value"], np.ones((SYMBOLS, 1), w["value"].dtype)], axis=1)


def _safe(sums: np.ndarray) -> bool:
    return bool(sums.min() > LEAST and sums.max() < MOST)


def _looked(table: np.ndarray, distance: np.ndarray, symbols: np.ndarray, first: int, room: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Rows of the joined table for windows (rows), and for the places from ``first`` on: attention weights, their sums, means.

    The weights are not divided by their sums. They are shifted by the largest one of a row only where sums leave a safe range.
    """
    rows = np.take(table, symbols, axis=0, out=_kept(room, "rows", (*symbols.shape, table.shape[1]), table.dtype), mode="clip")
    q, k, values = rows[:, first:, :WIDTH], rows[:, :, WIDTH : 2 * WIDTH], rows[:, :, 2 * WIDTH :]
    a = _kept(room, "a", (len(symbols), WINDOW - first, WINDOW), table.dtype)
    pads = symbols == PAD
    padded = np.flatnonzero(pads.any(axis=1))
    mask = _mask(distance, first)
    for shifted in (False, True):
        np.matmul(q, k.transpose(0, 2, 1), out=a)
        if shifted:
            a += mask
            a += np.where(pads, FAR, np.float32(0))[:, None, :]
            a -= a.max(axis=2, keepdims=True)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(a, out=a)
            if not shifted:
                a *= np.exp(mask)
                if len(padded):
                    a[padded] *= ~pads[padded][:, None, :]
            summed = np.matmul(a, values, out=_kept(room, "summed", (len(symbols), WINDOW - first, WIDTH + 1), table.dtype))
        sums = summed[:, :, WIDTH:]
        sums[pads[:, first:] & (sums[:, :, 0] == 0)] = 1  # a pad has no target, and may have nothing to look at
        if shifted or _safe(sums):
            break
    return rows, a, sums, summed[:, :, :WIDTH] / sums


def _exponents(looked: np.ndarray, out: np.ndarray, own: np.ndarray, room: dict[str, np.ndarray]) -> np.ndarray:
    """Class scores of each place (rows), less the largest of the place."""
    z = np.matmul(looked, out, out=_kept(room, "z", (len(looked), CLASSES), looked.dtype))
    z += own
    half = z.shape[1] // 2
    top = np.maximum(z[:, :half], z[:, half:], out=_kept(room, "top", (len(looked), half), looked.dtype))
    while not half % 2:  # by halves, as whole rows are compared at once
        half //= 2
        top = np.maximum(top[:, :half], top[:, half : 2 * half], out=top[:, :half])
    z -= top.max(axis=1, keepdims=True)
    return z


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each text in a padded stream, its number of windows, and the length of the stream.

    A text of n subwords takes LEAD pads, the start, n subwords, and pads up to a whole number of strides.
    """
    windows = -(-(lengths + 1) // STRIDE)
    sizes = LEAD + windows * STRIDE
    first = np.cumsum(sizes) - sizes
    return first, windows, int(sizes.sum())


def stream(ids: np.ndarray, lengths: np.ndarray, known: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and target classes (-1: none) of texts that lie one after another in ``ids``, with the layout."""
    first, windows, size = layout(lengths)
    symbols, targets = np.full(size, PAD, np.int16), np.full(size, -1, np.int8)
    begin = first + LEAD
    symbols[begin] = START
    before = np.cumsum(lengths) - lengths
    place = np.arange(len(ids)) + np.repeat(begin - before, lengths)
    symbols[place + 1] = known.symbol[ids] if len(ids) else 0
    targets[place] = known.kind[ids] if len(ids) else 0
    targets[begin + lengths] = END
    return symbols, targets, first, windows


def log10_scores(w: dict[str, np.ndarray], ids: np.ndarray, lengths: np.ndarray, known: Subwords) -> np.ndarray:
    """log10 of the probability of each text: its subwords and its end."""
    if not len(lengths):
        return np.zeros(0)
    symbols, targets, first, windows = stream(ids, lengths, known)
    text = np.repeat(np.arange(len(lengths)), windows)
    begin = np.repeat(first, windows) + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows))
    total = np.zeros(len(lengths))
    table, room = _joined(w), {}
    for at in range(0, len(begin), BLOCK):
        some = begin[at : at + BLOCK]
        seen = symbols[some[:, None] + np.arange(WINDOW)]
        wanted = targets[some[:, None] + np.arange(LEAD, WINDOW)].ravel()
        *_, looked = _looked(table, w["distance"], seen, LEAD, room)
        here, own = np.flatnonzero(wanted >= 0), seen[:, LEAD:].ravel()
        own = np.take(w["own"], own, axis=0, out=_kept(room, "own", (len(own), CLASSES), table.dtype), mode="clip")
        z = _exponents(looked.reshape(-1, WIDTH), w["out"], own, room)
        hit = z[here, wanted[here]].astype(np.float64)
        np.exp(z, out=z)
        hit -= np.log(z @ np.ones(CLASSES, z.dtype))[here]
        total += np.bincount(text[at + here // STRIDE], weights=hit, minlength=len(total))
    total /= np.log(10)
    if len(ids):
        total += np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=known.share[ids], minlength=len(total))
    return total


def _gathered(rows: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows of each symbol that is there; the order by symbol, and where each symbol begins in it."""
    return np.add.reduceat(rows[order], begin, axis=0)


def _sparse_gradient(table: np.ndarray, w: dict[str, np.ndarray], symbols: np.ndarray, targets: np.ndarray, room: dict[str, np.ndarray]) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
    """Mean loss, the symbols that are there, and the gradient: for the joined ``table`` and ``own`` their rows alone."""
    rows, a, sums, looked = _looked(table, w["distance"], symbols, 0, room)
    q, k, values = rows[:, :, :WIDTH], rows[:, :, WIDTH : 2 * WIDTH], rows[:, :, 2 * WIDTH :]
    flat_symbols, wanted = symbols.ravel(), targets.ravel()
    order = np.argsort(flat_symbols, kind="stable")
    there, begin = np.unique(flat_symbols[order], return_index=True)
    here = np.flatnonzero(wanted >= 0)
    n = max(len(here), 1)
    own = np.take(w["own"], flat_symbols, axis=0, out=_kept(room, "own", (len(flat_symbols), CLASSES), table.dtype), mode="clip")
    p = _exponents(looked.reshape(-1, WIDTH), w["out"], own, room)
    hit = p[here, wanted[here]]
    np.exp(p, out=p)
    total = p @ np.ones(CLASSES, p.dtype)
    loss = float((np.log(total[here]) - hit).sum()) / n
    p[here, wanted[here]] -= total[here]
    p *= np.where(wanted >= 0, 1 / (n * total), 0).astype(p.dtype)[:, None]
    # the weights' own gradient is taken against the mean over the window, one more column of the product with the values
    d = _kept(room, "d", sums.shape[:2] + (WIDTH + 1,), p.dtype)
    np.divide((p @ w["out"].T).reshape(looked.shape), sums, out=d[:, :, :WIDTH])
    np.negative(np.einsum("btw,btw->bt", d[:, :, :WIDTH], looked), out=d[:, :, WIDTH])
    d_a = np.matmul(d, values.transpose(0, 2, 1), out=_kept(room, "d_a", a.shape, p.dtype))
    d_a *= a
    d_rows = _kept(room, "d_rows", (*symbols.shape, 3 * WIDTH), p.dtype)
    np.matmul(d_a, k, out=d_rows[:, :, :WIDTH])
    np.matmul(d_a.transpose(0, 2, 1), q, out=d_rows[:, :, WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), d[:, :, :WIDTH], out=d_rows[:, :, 2 * WIDTH :])
    return loss, there, {
        "table": _gathered(d_rows.reshape(-1, 3 * WIDTH), order, begin),
        "own": _gathered(p, order, begin),
        "out": (p.T @ looked.reshape(-1, WIDTH)).T,
        "distance": np.bincount(np.maximum(_BACK, 0).ravel(), weights=d_a.sum(axis=0).ravel(), minlength=WINDOW).astype(p.dtype),
    }


def gradient(w: dict[str, np.ndarray], symbols: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of windows (rows) over the places that have a target, and its gradient."""
    loss, there, some = _sparse_gradient(_joined(w), w, symbols, targets, {})
    grads = {name: np.zeros_like(values) for name, values in w.items()}
    for nth, name in enumerate(("query", "key", "value")):
        grads[name][there] = some["table"][:, nth * WIDTH : (nth + 1) * WIDTH]
    grads["own"][there] = some["own"]
    return loss, grads | {"out": some["out"], "distance": some["distance"]}


def train(w: dict[str, np.ndarray], symbols: np.ndarray, targets: np.ndarray, rate: float = RATE) -> dict[str, np.ndarray]:
    """One pass over windows (rows) in the given order, with steps scaled by the root of the summed squared gradients."""
    w = {name: values.copy() for name, values in w.items()}
    table, room = _joined(w), {}
    learnt = {"table": table[:, : 3 * WIDTH], **{name: w[name] for name in ("own", "out", "distance")}}
    squares = {name: np.full_like(values, 1e-8) for name, values in learnt.items()}
    for at in range(0, len(symbols), BLOCK):
        _, there, grads = _sparse_gradient(table, w, symbols[at : at + BLOCK], targets[at : at + BLOCK], room)
        for name, g in grads.items():
            rows = there if name in ("table", "own") else slice(None)  # elsewhere the gradient is nil, and so is the step
            summed = squares[name][rows] + g * g
            squares[name][rows] = summed
            learnt[name][rows] -= rate * g / np.sqrt(summed)
    w["query"], w["key"], w["value"] = (np.ascontiguousarray(x) for x in np.split(learnt["table"], 3, axis=1))
    return w
