"""Log probabilities of texts: add-one word counts of the whole corpus, and a causal self-attention model on subwords.

Texts are cut into slices of about ``SLICE`` bytes whose words are numbered. The distinct words of a slice go out to parts
by a hash of the word; a part adds up the training counts of its words, splits each distinct word into subwords once, and
sends counts and subwords back to the slices. So a word is encoded once for the corpus, and what is shuffled are the
distinct words of slices, not the words of texts.

Subword counts of all training texts decide symbols, classes and shares (``attention.subwords``). All training texts are
cut into windows, so that every subword and end is learnt from; shards of windows train side by side from the same weights,
their mean starts the next round. Scores come from windows that overlap (``attention.log10_scores``).
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cohortloom.llm import attention, bpe, textbytes
from cohortloom.llm.components import settled
from cohortloom.llm.samples import is_held_out

#: Bytes of text of a slice (a longer text is a slice of its own); distinct words of slices in a part; windows of a shard.
SLICE, PART_WORDS, SHARD_WINDOWS = 1 << 24, 500_000, 1 << 17
#: Passes over the training windows, with a mean over the shards after each.
ROUNDS = 3
#: Groups that shards' weights are added up in before the driver sees them.
MEANS = 8
#: Subwords that are laid out together.
LAID_OUT = 1 << 18

_SPACE = textbytes.runs_of("nonspace")
_ALL = np.ones(256, bool)
_SLICE_SCHEMA = "slice long, doc_ids array<long>, held array<boolean>, sizes binary, codes binary, lengths binary, bytes binary, counts binary, n_words long"
_PART_SCHEMA = "slice long, part long, places binary, lengths binary, bytes binary, counts binary"
_BACK_SCHEMA = "slice long, places binary, counts binary, lengths binary, ids binary, id int, n long"
_SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_WINDOW_SCHEMA = "shard long, keys binary, symbols binary, targets binary"


def packed(values: np.ndarray) -> bytes:
    """The numbers compressed, all first bytes before all second bytes and so on: the high ones are mostly zero."""
    raw = np.ascontiguousarray(values).reshape(-1, 1).view(np.uint8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(raw: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return planes.reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


# --- slices: numbered words ------------------------------------------------------------------------


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Words per text, and the words one after another."""
    data = textbytes.fold_case(data)
    w = textbytes.words(data, offsets, _SPACE)
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    own = data[_SPACE[data]]
    return np.diff(w.doc_first), pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(own)])


def _slice_row(number: int, ids: pa.Array, held: np.ndarray, sizes: np.ndarray, words: list[pa.Array]) -> pa.RecordBatch:
    coded = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy()
    distinct = coded.dictionary
    counts = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(distinct)).astype(np.int32)
    lengths = pc.binary_length(distinct).to_numpy().astype(np.int32)
    raw = np.frombuffer(distinct.buffers()[2], np.uint8)[: lengths.sum()] if len(distinct) else np.zeros(0, np.uint8)
    row = [number, None, None, packed(sizes.astype(np.int32)), packed(codes.astype(np.int32)), packed(lengths), packed(raw), packed(counts), len(distinct)]
    names = ["slice", "doc_ids", "held", "sizes", "codes", "lengths", "bytes", "counts", "n_words"]
    columns = [pa.array([v]) for v in row]
    columns[1] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns[2] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(held))
    return pa.RecordBatch.from_arrays(columns, names)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        held = batch["held_out"].to_numpy(zero_copy_only=False)
        ids, sizes, words, first, size = batch["doc_id"], [], [], 0, 0
        for at, data, offsets in [*textbytes.slices(batch["text"]), (batch.num_rows, None, None)]:
            if at > first and (data is None or size + len(data) > SLICE):
                yield _slice_row(number, ids.slice(first, at - first), held[first:at], np.concatenate(sizes), words)
                number, first, size, sizes, words = number + 1, at, 0, [], []
            if data is not None:
                n, own = _words(data, offsets)
                sizes.append(n)
                words.append(own)
                size += len(data)
    textbytes.give_back()


# --- parts: counts and subwords of distinct words --------------------------------------------------


def _dealt(parts: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, raw, counts = unpacked(row["lengths"], np.int32), unpacked(row["bytes"], np.uint8), unpacked(row["counts"], np.int32)
                if not len(lengths):
                    continue
                ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                part = (textbytes.words(raw, ends, _ALL).hashes() % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                starts = np.searchsorted(part[order], np.arange(parts + 1))
                out = {name: [] for name in ("slice", "part", "places", "lengths", "bytes", "counts")}
                for p in np.flatnonzero(np.diff(starts)):
                    places = order[starts[p] : starts[p + 1]]
                    at = np.repeat(ends[places] - np.cumsum(lengths[places]) + lengths[places], lengths[places]) + np.arange(lengths[places].sum())
                    for name, value in zip(out, (row["slice"], int(p), packed(np.diff(places, prepend=0).astype(np.int32)), packed(lengths[places]), packed(raw[at]), packed(counts[places]))):
                        out[name].append(value)
                yield pa.record_batch(out)

    return deal


def _counted(path: str):
    def count(table: pa.Table) -> pa.Table:
        v = bpe.vocabulary(path)
        lengths = [unpacked(x, np.int32) for x in table["lengths"].to_pylist()]
        ends = np.concatenate([[0], *lengths]).cumsum(dtype=np.int64)
        raw = np.concatenate([unpacked(x, np.uint8) for x in table["bytes"].to_pylist()])
        coded = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        codes = coded.indices.to_numpy()
        own = np.concatenate([unpacked(x, np.int32) for x in table["counts"].to_pylist()]).astype(np.int64)
        counts = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(counts, codes, own)
        order = pc.array_sort_indices(coded.dictionary)  # words that share a piece stand together, so few pieces are kept
        back_to = np.argsort(order.to_numpy(), kind="stable")
        ids = [np.frombuffer(v.encode(word.decode("utf-8", "replace")), np.int32) for word in coded.dictionary.take(order).to_pylist()]
        v.forget()
        ids = [ids[i] for i in back_to]
        sizes = np.array([len(x) for x in ids], np.int64)
        ids = np.concatenate(ids)
        first = np.cumsum(sizes) - sizes
        out = {name: [] for name in ("counts", "lengths", "ids")}
        at = 0
        for n in map(len, lengths):
            some = codes[at : at + n]
            own_ids = ids[np.arange(sizes[some].sum()) + np.repeat(first[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some])]
            for name, value in zip(out, (counts[some], sizes[some].astype(np.int32), own_ids.astype(np.int32))):
                out[name].append(packed(value))
            at += n
        back = pa.table({"slice": table["slice"], "places": table["places"], **{k: pa.array(x, pa.binary()) for k, x in out.items()}, "id": pa.nulls(at := table.num_rows, pa.int32()), "n": pa.nulls(at, pa.int64())})
        uses = np.bincount(ids, weights=np.repeat(counts, sizes), minlength=len(v.tokens)).astype(np.int64)
        some = np.flatnonzero(uses)
        statistics = {"id": np.r_[[-2, -1], some].astype(np.int32), "n": np.r_[[counts.sum(), (counts > 0).sum()], uses[some]].astype(np.int64)}
        none = {name: pa.nulls(len(some) + 2, back.schema.field(name).type) for name in ("slice", "places", "counts", "lengths", "ids")}
        textbytes.give_back()
        return pa.concat_tables([back, pa.table(none | statistics).select(back.schema.names)])

    return count


# --- windows, training and scores ------------------------------------------------------------------


def _slice_of(table: pa.Table):
    """A slice: ids, held-out flags, words per text, word codes; counts and subwords (with their lengths) of its words."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["codes"] is not None)
    back = [r for r in rows if r["codes"] is None]
    n = sum(len(unpacked(r["lengths"], np.int32)) for r in back)
    counts, lengths, first = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    ids, size = [np.zeros(0, np.int32)], 0
    for r in back:
        places, each = np.cumsum(unpacked(r["places"], np.int32)), unpacked(r["lengths"], np.int32)
        counts[places], lengths[places] = unpacked(r["counts"], np.int64), each
        first[places] = size + np.cumsum(each) - each
        ids.append(unpacked(r["ids"], np.int32))
        size += int(each.sum())
    return own["doc_ids"], np.array(own["held"], bool), unpacked(own["sizes"], np.int32).astype(np.int64), unpacked(own["codes"], np.int32), counts, lengths, first, np.concatenate(ids)


def _texts(sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray, first: np.ndarray, ids: np.ndarray) -> Iterable[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``LAID_OUT`` subwords: first and last text, their subwords, and the subwords per text."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    subwords = np.concatenate([[0], np.cumsum(lengths[codes])])
    per_text = np.diff(subwords[ends])
    before = np.concatenate([[0], np.cumsum(per_text)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(before, before[at] + LAID_OUT, "right")) - 1)
        some = codes[ends[at] : ends[to]]
        each = lengths[some]
        place = np.arange(each.sum()) + np.repeat(first[some] - np.cumsum(each) + each, each)
        yield at, to, ids[place], per_text[at:to]
        at = to


def _cut(known: attention.Subwords, shards: int):
    """Training texts cut into windows side by side, every subword and end the target of one window, dealt to the shards.

    The cuts of a text start at a place that follows from its place in the slice.
    """

    def cut(table: pa.Table) -> pa.Table:
        _, held, sizes, codes, _, lengths, first, ids = _slice_of(table)
        number = np.uint64(table["slice"][0].as_py())
        steps = np.arange(attention.WINDOW)
        found = [(np.zeros(0, np.uint64), np.zeros((0, len(steps)), np.int16), np.zeros((0, len(steps)), np.int8))]
        for at, to, own, n in _texts(sizes, codes, lengths, first, ids):
            symbols, targets, begin, _ = attention.stream(own, n, known)
            mixed = textbytes.mix((number << np.uint64(20)) + np.arange(at, to, dtype=np.uint64))
            start = begin + ((mixed >> np.uint64(8)) % np.uint64(attention.LEAD + 1)).astype(np.int64)
            last = begin + attention.LEAD + n + 1
            windows = np.where(held[at:to], 0, -(-(last - start) // attention.WINDOW))
            nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            where = (np.repeat(start, windows) + nth * attention.WINDOW)[:, None] + steps
            ends = np.repeat(last, windows)[:, None]
            beyond = where >= ends
            where = np.minimum(where, ends - 1)
            seen, wanted = np.where(beyond, attention.PAD, symbols[where]), np.where(beyond, -1, targets[where])
            found.append((textbytes.mix(np.repeat(mixed, windows) + nth.astype(np.uint64)), seen.astype(np.int16), wanted.astype(np.int8)))
        keys, seen, wanted = (np.concatenate(x) for x in zip(*found))
        shard = (textbytes.mix(keys) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        there = np.flatnonzero(np.diff(bounds))
        parts = [order[bounds[s] : bounds[s + 1]] for s in there]
        packs = {"keys": [keys[x].tobytes() for x in parts], "symbols": [packed(seen[x]) for x in parts], "targets": [packed(wanted[x]) for x in parts]}
        return pa.table({"shard": pa.array(there, pa.int64()), **{name: pa.array(x, pa.binary()) for name, x in packs.items()}})

    return cut


def _trained(weights: np.ndarray, start: int):
    def fit(rows: Iterable[tuple[int, Row]]) -> Iterator[tuple[int, bytes, int]]:
        shards: dict[int, list[Row]] = {}
        for shard, row in rows:
            shards.setdefault(shard, []).append(row)
        while shards:
            shard, own = shards.popitem()
            keys = np.frombuffer(b"".join(r["keys"] for r in own), np.uint64)
            order = np.argsort(textbytes.mix(keys + np.uint64(start)), kind="stable")
            symbols = np.concatenate([unpacked(r["symbols"], np.int16) for r in own]).reshape(-1, attention.WINDOW)[order]
            targets = np.concatenate([unpacked(r["targets"], np.int8) for r in own]).reshape(-1, attention.WINDOW)[order]
            del own, keys
            yield shard, attention.flat(attention.train(attention.shaped(weights), symbols, targets)).tobytes(), 1

    return fit


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table["weights"].to_pylist())
    return pa.table({"weights": pa.array([total.tobytes()], pa.binary()), "n": [sum(table["n"].to_pylist())]})


def shards_of(subwords: int, texts: int) -> int:
    """Shards of about ``SHARD_WINDOWS`` windows, from the training texts and their subwords."""
    return max(1, -(-((subwords + texts) // attention.WINDOW + texts) // SHARD_WINDOWS))


def train(dealt: DataFrame, shards: int, n: int, prior: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (flat) after ``rounds`` passes over all windows of ``n`` texts: shards of equal expected size, and the mean of their weights.

    The windows are shuffled to their shards once: every round reads the same shuffle files, and no other copy is written.
    """
    weights = attention.flat(attention.fresh(prior))
    if not n:
        return weights
    at_shards = dealt.rdd.map(lambda row: (row["shard"], row)).partitionBy(shards, int)
    for r in range(rounds):
        fitted = dealt.sparkSession.createDataFrame(at_shards.mapPartitions(_trained(weights, r)), "shard long, weights binary, n long")
        sums = fitted.withColumn("mean", F.pmod("shard", F.lit(MEANS))).groupBy("mean").applyInArrow(_added, "weights binary, n long").collect()
        weights = (sum(np.frombuffer(s["weights"], np.float64) for s in sums) / sum(s["n"] for s in sums)).astype(np.float32)
    return weights


def _scored(weights: np.ndarray, known: attention.Subwords, n: int, distinct: int, ends: int):
    def score(table: pa.Table) -> pa.Table:
        doc_ids, held, sizes, codes, counts, lengths, first, ids = _slice_of(table)
        w = attention.shaped(weights)
        text = np.repeat(np.arange(len(sizes)), sizes)
        seen = counts[codes]
        base = np.bincount(text, weights=np.log10(seen + 1.0), minlength=len(sizes)) + np.log10(ends + 1.0)
        base -= (sizes + 1) * np.log10(float(n + distinct + 1))
        n_known = np.bincount(text, weights=seen > 0, minlength=len(sizes)).astype(np.int64) + (ends > 0)
        scores = [attention.log10_scores(w, own, each, known) for _, _, own, each in _texts(sizes, codes, lengths, first, ids)]
        textbytes.give_back()
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "held_out": held, "n_tokens": sizes + 1, "n_known": n_known, "base_score": base, "score": np.concatenate([np.zeros(0), *scores])})

    return score


def score(documents: DataFrame, path: str, modulus: int = 7, rest: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    ``documents`` needs doc_id (a whole number) and text; other columns are ignored. Tokens are words between white space
    with A-Z in lower case, and one end. Learnt from are the rows whose crc32(doc_id as text) mod ``modulus`` is not
    ``rest``; a null id is learnt from. A null or empty text has no words, only its end. Repeated rows count and come back
    each time. Without training rows, base and model know nothing and every text still has a score. ``path`` names the
    tokenizer file, which every task reads. An empty table has no rows.

    The driver holds the counts of the subwords and the weights of the model, neither of which grows with the table.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_held_out("doc_id", modulus, rest).alias("held_out"))
    slices = settled(rows.mapInArrow(_slices, _SLICE_SCHEMA))
    size = slices.agg(F.sum("n_words").alias("words"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("train")).first()
    ends, parts = size["train"] or 0, max(1, -(-(size["words"] or 0) // PART_WORDS))
    dealt = slices.select("slice", "lengths", "bytes", "counts").mapInArrow(_dealt(parts), _PART_SCHEMA)
    back = settled(dealt.groupBy("part").applyInArrow(_counted(path), _BACK_SCHEMA))
    uses = {r["id"]: r["n"] for r in back.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    n, distinct = uses.pop(-2, 0) + ends, uses.pop(-1, 0) + (ends > 0)
    counts = np.zeros(len(bpe.vocabulary(path).tokens), np.int64)
    counts[list(uses)] = list(uses.values())
    known = attention.subwords(counts, ends)
    texts = slices.select("slice", "doc_ids", "held", "sizes", "codes").unionByName(back.where("id IS NULL").select("slice", "places", "counts", "lengths", "ids"), allowMissingColumns=True).groupBy("slice")
    shards = shards_of(int(counts.sum()), ends)
    weights = train(texts.applyInArrow(_cut(known, shards), _WINDOW_SCHEMA), shards, ends, known.prior)
    scored = texts.applyInArrow(_scored(weights, known, n, distinct, ends), _SCORE_SCHEMA)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
