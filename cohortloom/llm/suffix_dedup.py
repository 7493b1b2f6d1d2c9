"""Exact removal of repeated strings: every byte covered by a 100-byte string that also starts earlier goes.

1. Texts are cut into pieces by anchors (``pieces``); equal 100-byte windows lie in pieces with the same anchor hash.
   Pieces are dealt by that hash. Of pieces with equal bytes (anchor and content hash, 96 bits) the earliest stays, the
   others are repeated as a whole. Within one buffer of a task that is settled before anything moves.
2. Anchors with several different pieces are left. The bytes of their earliest pieces go to shards by anchor hash. In a
   shard, windows whose hash stands once can't be repeated; the rest make strings, equal ones are taken once, and a suffix
   array by induced sorting with permuted common prefixes tells which windows are equal. All but the earliest of each class
   are repeated. An anchor with more than ``GROUP_PIECES`` different pieces, or with ``FREQUENT`` in one buffer, does not go
   to a shard: its pieces are dealt by content in step 1, and then as single windows by the windows' own hashes (96 bits).
   A buffer settles its equal windows first, so a window that very many texts have moves once for each buffer.
3. The spans of all steps are merged by text and cut out.

Nothing is compared across documents but through the order (id, digest of the text, start). Disk use is about 20 bytes for
every 30 bytes of text, and two shuffles of the texts.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import columns, pieces, textbytes
from cohortloom.llm.components import settled
from cohortloom.llm.suffix_array import common_prefixes, suffix_array

WINDOW = pieces.WINDOW
#: Bytes of text of one buffer of a task, pieces of one part, bytes of the pieces of one shard.
BUFFER_BYTES = 8 << 20
PART_PIECES = 400_000
SHARD_BYTES = 1 << 20
#: Different pieces of one anchor in a buffer, and in all, from which its windows are dealt one by one; windows of a buffer and of a part.
FREQUENT = 128
GROUP_PIECES = 4096
BUFFER_WINDOWS = 500_000
PART_WINDOWS = 1_000_000
_KEY = ["no_id", "id", "digest"]
_DEALT = "part long, no_ids binary, ids binary, digests binary, counts binary, starts binary, windows binary, anchors binary, contents binary, hot binary"
_SPANS = "no_id boolean, id long, digest long, start int, length int, anchor long"
_FOUND = f"{_SPANS}, hot boolean"
_EMPTY = np.zeros(0, np.int64)


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _of_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _earliest(anchor: np.ndarray, content: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting by (anchor, content, order); in that sorting, the first of each (anchor, content) and the anchors' heads."""
    by = np.lexsort((order, content, anchor))
    anchor, content = anchor[by], content[by]
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]][: len(by)]
    new_content = new_anchor | np.r_[True, content[1:] != content[:-1]][: len(by)]
    return by, new_content, new_anchor


def _merged(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a text made one."""
    if not len(doc):
        return _EMPTY, _EMPTY, _EMPTY
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], start[by] + length[by]
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * far + end)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (doc[1:] * far + start[1:] > reach[:-1])]
    head = np.flatnonzero(new)
    return doc[head], start[head], np.maximum.reduceat(end, head) - start[head]


def _packed(part, doc, start, windows, anchor, content, no_id, ids, digests) -> pa.RecordBatch | None:
    if not len(part):
        return None
    by = np.lexsort((doc, part))
    part, doc, start, windows, anchor, content = (x[by] for x in (part, doc, start, windows, anchor, content))
    new_doc = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])])
    count = np.diff(np.r_[new_doc, len(part)]).astype(np.uint32)
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[cut[1:], len(part)]
    doc_cut = np.searchsorted(new_doc, np.r_[cut, len(part)])
    own = doc[new_doc]
    by_doc = [(x[own], doc_cut[:-1], doc_cut[1:]) for x in (no_id, ids, digests)] + [(count, doc_cut[:-1], doc_cut[1:])]
    columns = [[x[a:b].tobytes() for a, b in zip(first, last)] for x, first, last in by_doc]
    for x in (start.astype(np.uint32), windows.astype(np.uint32)):
        columns.append([x[a:b].tobytes() for a, b in zip(cut, ends)])
    for x in (anchor, content):
        columns.append([_six(x[a:b]) for a, b in zip(cut, ends)])
    return _dealt_rows(part[cut], [*columns, [b""] * len(cut)])


def _packed_hot(part: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch | None:
    """The hot anchors of a buffer, for the parts where their other pieces go."""
    if not len(part):
        return None
    by = np.argsort(part, kind="stable")
    part, anchor = part[by], anchor[by]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    hot = [_six(anchor[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(part)])]
    return _dealt_rows(part[cut], [*[[b""] * len(cut)] * 8, hot])


def _dealt_rows(part: np.ndarray, columns: list[list[bytes]]) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in _DEALT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=names)


def _settled_buffer(parts: int, frequent: int, doc, start, windows, anchor, content, no_id, ids, digests) -> Iterator[pa.RecordBatch]:
    """Deals the pieces of a buffer: equal ones are settled, the earliest goes to its anchor's part.

    Parts from ``parts`` on take the spans of the others, and parts from twice ``parts`` on the pieces of hot anchors, by content.
    """
    ranks = np.zeros(len(ids), np.int64)
    by_key = np.lexsort((digests, ids, no_id))
    same = np.r_[True, (no_id[by_key][1:] != no_id[by_key][:-1]) | (ids[by_key][1:] != ids[by_key][:-1]) | (digests[by_key][1:] != digests[by_key][:-1])][: len(ids)]
    ranks[by_key] = np.cumsum(same)
    anchor, content = anchor & ~np.uint64(0xFFFF), content & ~np.uint64(0xFFFF)
    order = ranks[doc] << 32 | start
    by, new, new_anchor = _earliest(anchor, content, order)
    first_order = order[by][np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else order
    gone = by[order[by] != first_order]
    stay = by[new]
    part = ((anchor[stay] >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
    if len(stay):
        head = np.flatnonzero(new_anchor[new])
        kinds = np.diff(np.r_[head, len(stay)])
        often = head[kinds >= frequent]
        yield _packed_hot(part[often], anchor[stay[often]])
        by_content = 2 * parts + ((content[stay] >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
        part = np.where(np.repeat(kinds >= frequent, kinds), by_content, part)
    yield _packed(part, doc[stay], start[stay], windows[stay], anchor[stay], content[stay], no_id, ids, digests)
    span_doc, span_start, span_length = _merged(doc[gone], start[gone], windows[gone] + WINDOW - 1)
    if len(span_doc):
        zero = np.zeros(len(span_doc), np.uint64)
        part = parts + (textbytes.mix(digests.view(np.uint64)[span_doc]) % np.uint64(parts)).astype(np.int64)
        yield _packed(part, span_doc, span_start, span_length, zero, zero, no_id, ids, digests)


def _keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return table["no_id"].to_numpy().astype(np.uint8), table["id"].to_numpy(), table["digest"].to_numpy()


def _deal(parts: int, frequent: int):
    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = []
        for first, data, offsets in textbytes.slices(table["text"]):
            p = pieces.cut(data, offsets)
            p.doc = p.doc + first
            found.append(p)
        fields = (np.concatenate([getattr(p, f) for p in found]) for f in ("doc", "start", "windows", "anchor", "content"))
        yield from _settled_buffer(parts, frequent, *fields, *_keys_of(table))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 11):
                some = batch.slice(at, 1 << 11)
                held.append(some)
                size += some["text"].nbytes
                if size >= BUFFER_BYTES:
                    yield from (b for b in emit(pa.Table.from_batches(held)) if b is not None)
                    held, size = [], 0
        if held:
            yield from (b for b in emit(pa.Table.from_batches(held)) if b is not None)
        textbytes.give_back()

    return deal


def _settle_part(parts: int, most: int):
    """Of one part: spans of the pieces that stand earlier too (no anchor), and the pieces left, hot or for the suffix arrays."""

    def settle(table: pa.Table) -> pa.Table:
        def read(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])

        count = read("counts", np.uint32)
        no_id, ids, digests = (np.repeat(read(c, k), count) for c, k in (("no_ids", np.uint8), ("ids", np.int64), ("digests", np.int64)))
        start, windows = read("starts", np.uint32).astype(np.int64), read("windows", np.uint32).astype(np.int64)

        def rows(at: np.ndarray, length: np.ndarray, anchor: np.ndarray | None, hot: np.ndarray | None = None) -> pa.Table:
            return pa.table({
                "no_id": pa.array(no_id[at] > 0), "id": pa.array(ids[at]), "digest": pa.array(digests[at]), "start": pa.array(start[at].astype(np.int32)),
                "length": pa.array(length.astype(np.int32)), "anchor": pa.nulls(len(at), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)),
                "hot": pa.nulls(len(at), pa.bool_()) if hot is None else pa.array(hot),
            })

        textbytes.give_back()
        part = table["part"][0].as_py()
        if parts <= part < 2 * parts:
            return rows(np.arange(len(start)), windows, None)
        anchor = np.concatenate([_of_six(x) for x in table["anchors"].to_pylist()])
        content = np.concatenate([_of_six(x) for x in table["contents"].to_pylist()])
        often = np.concatenate([_of_six(x) for x in table["hot"].to_pylist()])
        by = np.lexsort((start, digests, ids, no_id, content, anchor))
        new_anchor = np.r_[True, anchor[by][1:] != anchor[by][:-1]][: len(by)]
        new = new_anchor | np.r_[True, content[by][1:] != content[by][:-1]][: len(by)]
        first = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = by[(start[by] != start[first]) | (ids[by] != ids[first]) | (digests[by] != digests[first]) | (no_id[by] != no_id[first])]
        kinds = np.diff(np.flatnonzero(np.r_[new_anchor[new], True]))[np.cumsum(new_anchor) - 1]
        hot = (kinds > most) | (part >= 2 * parts) | np.isin(anchor[by], often)
        chosen = new & (hot | (kinds > 1))
        left = by[chosen]
        return pa.concat_tables([rows(later, windows[later] + WINDOW - 1, None), rows(left, windows[left] + WINDOW - 1, anchor[left], hot[chosen])])

    return settle


def _window_hashes(data: np.ndarray) -> np.ndarray:
    h, power, size, kept = textbytes.BYTE_CODES[data], int(textbytes.BASE), 1, {}
    while size <= 64:
        if size in (4, 32, 64):
            kept[size] = (h, power)
        h, power, size = h[:-size] * np.uint64(power) + h[size:], power * power & 0xFFFFFFFFFFFFFFFF, size * 2
    n = len(data) - WINDOW + 1
    return (kept[64][0][:n] * np.uint64(kept[32][1]) + kept[32][0][64 : 64 + n]) * np.uint64(kept[4][1]) + kept[4][0][96 : 96 + n]


def _deal_windows(parts: int, most: int):
    """Deals the windows of pieces (no_id, id, digest, start, bytes) like pieces of one window, by two hashes of all bytes."""

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        raw = table["bytes"].to_pylist()
        length = np.array([len(x) for x in raw])
        offsets = np.r_[0, np.cumsum(length)]
        data = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(len(raw)), length - WINDOW + 1)
        first = np.r_[0, np.cumsum(length - WINDOW + 1)][:-1]
        inside = np.arange(len(row)) - first[row]
        place = offsets[row] + inside
        grams = pieces.gram_hashes(data)
        other = grams[place]
        for at in (pieces.GRAM, 2 * pieces.GRAM, WINDOW - pieces.GRAM):
            other = textbytes.mix(other * textbytes.BASE + grams[place + at])
        start = table["start"].to_numpy().astype(np.int64)[row] + inside
        fields = (row, start, np.ones(len(row), np.int64), textbytes.mix(_window_hashes(data)[place]), textbytes.mix(other + np.uint64(1)))
        yield from _settled_buffer(parts, len(row) + 1, *fields, *_keys_of(table))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 11):
                some = batch.slice(at, 1 << 11)
                held.append(some)
                size += some["bytes"].nbytes - (WINDOW - 1) * some.num_rows
                if size >= most:
                    yield from (b for b in emit(pa.Table.from_batches(held)) if b is not None)
                    held, size = [], 0
        if size:
            yield from (b for b in emit(pa.Table.from_batches(held)) if b is not None)
        textbytes.give_back()

    return deal


def repeated_windows(strings: list[bytes]) -> list[tuple[int, int]]:
    """(string, place) of every window that an earlier one equals; the strings and their places come in order."""
    lengths = np.array([len(x) for x in strings])
    offsets = np.r_[0, np.cumsum(lengths + 1)]
    text = np.zeros(offsets[-1], np.int64)
    for i, x in enumerate(strings):
        text[offsets[i] : offsets[i] + len(x)] = np.frombuffer(x, np.uint8).astype(np.int64) + 1
    sa = suffix_array(text)
    prefixes = common_prefixes(text.tolist(), sa, WINDOW)
    string = np.searchsorted(offsets, sa, "right") - 1
    joins = prefixes[sa] >= WINDOW
    joins[0] = False
    label = np.cumsum(~joins) - 1
    by = np.lexsort((sa, label))  # places in the joined text are in the strings' order
    label, place = label[by], sa[by]
    later = place[1:][label[1:] == label[:-1]]
    string = np.searchsorted(offsets, later, "right") - 1
    whole = later + WINDOW <= offsets[string] + lengths[string]  # equal prefixes may run on into the next string
    later, string = later[whole], string[whole]
    return list(zip(string.tolist(), (later - offsets[string]).tolist()))


def _sort_shard(table: pa.Table) -> pa.Table:
    """Spans of the windows of a shard that stand earlier too."""
    order = np.lexsort(tuple(table[c].to_numpy(zero_copy_only=False) for c in ("start", "digest", "id", "no_id")))
    fields = [table[c].to_numpy(zero_copy_only=False)[order] for c in (*_KEY, "start")]
    new = np.r_[True, np.any([x[1:] != x[:-1] for x in fields], axis=0)]  # a repeated row brings its pieces again
    table = table.take(pa.array(order[new]))
    raw = table["bytes"].to_pylist()
    start = table["start"].to_numpy().astype(np.int64)
    length = np.array([len(x) for x in raw])
    offsets = np.r_[0, np.cumsum(length)]
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes = _window_hashes(data)
    row = np.searchsorted(offsets, np.arange(len(hashes)), "right") - 1
    place = np.flatnonzero(np.arange(len(hashes)) + WINDOW <= offsets[row + 1])
    ordered = np.sort(hashes[place])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    at = np.minimum(np.searchsorted(twice, hashes[place]), max(0, len(twice) - 1))
    place = place[twice[at] == hashes[place]] if len(twice) else place[:0]
    spans: list[tuple[int, int, int]] = []  # row, place in the row, length
    if len(place):
        new = np.r_[True, (place[1:] != place[:-1] + 1) | (row[place][1:] != row[place][:-1])]
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, len(place)]) + WINDOW - 1
        first_of: dict[bytes, int] = {}
        strings, owner = [], []
        for p, n in zip(place[head].tolist(), size.tolist()):
            r = int(row[p])
            string = raw[r][p - int(offsets[r]) : p - int(offsets[r]) + n]
            if string in first_of:
                spans.append((r, p - int(offsets[r]), n))
            else:
                first_of[string] = p
                strings.append(string)
                owner.append((r, p - int(offsets[r])))
        for k, p in repeated_windows(strings):
            spans.append((owner[k][0], owner[k][1] + p, WINDOW))
    rows, places, sizes = (np.array(x, np.int64) for x in zip(*spans)) if spans else (_EMPTY, _EMPTY, _EMPTY)
    rows, places, sizes = _merged(rows, places, sizes)
    textbytes.give_back()
    return pa.table({
        "no_id": table["no_id"].take(pa.array(rows)), "id": table["id"].take(pa.array(rows)), "digest": table["digest"].take(pa.array(rows)),
        "start": pa.array((start[rows] + places).astype(np.int32)), "length": pa.array(sizes.astype(np.int32)), "anchor": pa.nulls(len(rows), pa.int64()),
    })


def _extract(texts: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
    out = []
    for text, begin, size in zip(texts, starts.to_pylist(), lengths.to_pylist()):
        raw = text.as_buffer().to_pybytes()
        out.append([raw[a : a + n] for a, n in zip(begin, size)])
    pieces_of = pa.array(out, pa.list_(pa.binary()))
    del out
    textbytes.give_back()
    return pieces_of


def _cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
    kept, removed = [], []
    for text, found in zip(texts, spans.to_pylist()):
        raw = text.as_buffer().to_pybytes()
        parts, merged, at = [], [], 0
        for begin, size in sorted((s["start"], s["length"]) for s in found or ()):
            end = begin + size
            if merged and begin <= at:
                merged[-1]["length"] = max(at, end) - merged[-1]["start"]
            else:
                parts.append(raw[at:begin])
                merged.append({"start": begin, "length": size})
            at = max(at, end)
        parts.append(raw[at:])
        kept.append(b"".join(parts))
        removed.append(merged)
    textbytes.give_back()
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, spans_type)], names=["kept", "removed"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans (no_id, id, digest, start, length) of the texts of ``docs`` (no_id, id, digest, text) that stand earlier too."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(1, -(-size // (32 * PART_PIECES)))
    dealt = docs.mapInArrow(_deal(parts, FREQUENT), _DEALT)
    found = settled(dealt.groupBy("part").applyInArrow(_settle_part(parts, GROUP_PIECES), _FOUND))
    whole, left = found.where("anchor IS NULL"), found.where("anchor IS NOT NULL")
    size = F.sum("length")
    sizes = {r.hot: r for r in left.groupBy("hot").agg(size.alias("bytes"), (size - F.count(F.lit(1)) * (WINDOW - 1)).alias("windows")).collect()}
    spans = whole.drop("anchor", "hot")
    if False in sizes:
        shards = max(1, -(-sizes[False].bytes // SHARD_BYTES))
        sent = _with_bytes(docs, left.where("NOT hot")).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        spans = spans.unionByName(sent.groupBy("shard").applyInArrow(_sort_shard, _SPANS).drop("anchor"))
    if True in sizes:
        parts = max(1, -(-sizes[True].windows // PART_WINDOWS))
        dealt = _with_bytes(docs, left.where("hot")).drop("anchor").mapInArrow(_deal_windows(parts, BUFFER_WINDOWS), _DEALT)
        by_window = dealt.groupBy("part").applyInArrow(_settle_part(parts, GROUP_PIECES), _FOUND)
        spans = spans.unionByName(by_window.where("anchor IS NULL").drop("anchor", "hot"))
    return spans


def _with_bytes(docs: DataFrame, left: DataFrame) -> DataFrame:
    """One row (no_id, id, digest, start, anchor, bytes) for each piece left, and for each row that brings it."""
    wanted = left.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "length", "anchor")).alias("pieces"))
    raw = F.arrow_udf(_extract, "array<binary>")("text", "pieces.start", "pieces.length")
    sent = docs.join(wanted, _KEY).select(*_KEY, F.arrays_zip(F.col("pieces"), raw.alias("bytes")).alias("z"))
    return sent.select(*_KEY, F.explode("z").alias("z")).select(*_KEY, "z.pieces.start", "z.pieces.anchor", "z.bytes")


def _whole_characters(kept: pa.Array) -> pa.Array:
    return pa.array([x.as_buffer().to_pybytes().decode("utf-8", "ignore") for x in kept], pa.string())


def as_text(kept: Column | str) -> Column:
    """Remaining bytes as text; what is left of a character that a cut went through goes too."""
    return F.arrow_udf(_whole_characters, "string")(kept)


def dedup(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``documents`` with kept (the remaining bytes) and removed (the maximal removed runs, in bytes), one row per input row.

    Ids are whole numbers; a null id comes after all others. Rows that repeat both id and text are one document, and come
    back as often as they stand there; different texts of one id are ordered by a digest. A null text is an empty one.
    Texts of fewer than 100 bytes lose nothing. Columns of the input named kept or removed are replaced, all others come back as they were.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = documents.drop("kept", "removed")
    *key, found, cut = columns.fresh(own, *[f"_{c}" for c in _KEY], "_spans", "_cut")
    values = [F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), F.xxhash64(text, F.octet_length(text))]
    keyed = own.withColumns(dict(zip(key, values)))
    spans = repeated_spans(keyed.select(*[F.col(k).alias(c) for k, c in zip(key, _KEY)], text.alias("text")))
    spans = spans.groupBy(*[F.col(c).alias(k) for k, c in zip(key, _KEY)]).agg(F.collect_list(F.struct("start", "length")).alias(found))
    without = F.arrow_udf(_cut_out, "kept binary, removed array<struct<start:int,length:int>>")
    out = keyed.join(spans, key, "left").withColumn(cut, without(text, F.col(found)))
    return out.select(*own.columns, f"{cut}.kept", f"{cut}.removed")
