"""Jaccard join on word n-grams: several global token orders filter the candidates, then sets are compared in full.

Documents with equal shingle sets are one set. Two sets of n1 and n2 shingles with a similarity of at least t share
``need(n1, n2)`` shingles, so, whatever order all shingles are put in, both have their first common shingle among their
first n - ceil(t n) + 1, and behind it enough shingles to reach that number. Three orders are used, all of which put the
shingles that only one set has first: those shingles can't be shared, so a set with as many of them as its prefix is long
is linked with nothing.

  first order    by the number of sets that have the shingle, rare ones first, then by hash,
  second, third  by two further hashes.

Candidates meet in the buckets of the first order; a pair is kept if the places of the shared shingle allow the
similarity and the prefixes of the second and third order overlap too. Verification intersects the full sets.

To find classes without listing all pairs of a group of copies, a bucket's members are compared with its ``HUBS`` most
central members first; classes found so far are merged, and only pairs from different classes go on. The last round takes
all pairs of different classes that share a bucket, so no link between classes is lost.

Shingle counts over the corpus: tokens (48 bits of a shingle's hash) go to parts by value, packed with the sets that have
them, and come back to the sets if some other set has them too. A token that ``FREQUENT`` sets of one buffer have is put
last in the first order everywhere; such rows stay with their sets instead of meeting in the token's part.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm import textbytes
from cohortloom.llm.components import components, settled

#: Words of a shingle and least similarity in hundredths, where the caller names no others.
WORDS = 4
PERCENT = 85
#: Members of a bucket, most central first, that all others are compared with in the first rounds.
HUBS = (2, 16)
#: Sets of one buffer that make a token frequent, and the tokens of a buffer and of a part.
FREQUENT = 64
BUFFER_TOKENS = 800_000
PART_TOKENS = 1_500_000

#: Ids of at most this many documents go to every executor.
BROADCAST_ROWS = 500_000

_SPACE_CUT = textbytes.runs_of("nonspace")
_TOKEN_BITS = 48
_TOKEN = (1 << _TOKEN_BITS) - 1
_LAST_CLASS = 0x7FFF


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number of the first text, number of texts, sorted distinct ``text << 48 | token``) for slices of the texts.

    A text with fewer than n words, but not none, has one shingle, of all its words.
    """
    for first, data, offsets in textbytes.slices(texts, most=1 << 15):
        data = textbytes.fold_case(data)
        w = textbytes.words(data, offsets, _SPACE_CUT)
        h = w.hashes()
        grams, at = textbytes.ngram_hashes(h, w.doc, n)
        parts, docs = [grams], [w.doc[at]]
        count = np.diff(w.doc_first)
        for m in range(1, n):
            heads = w.doc_first[:-1][count == m]
            if len(heads):
                short = h[heads] + np.uint64(m)
                for k in range(1, m):
                    short = textbytes.mix(short * textbytes.BASE + h[heads + k])
                parts.append(textbytes.mix(short))
                docs.append(w.doc[heads])
        token = np.concatenate(parts) >> np.uint64(64 - _TOKEN_BITS)
        packed = np.concatenate(docs).astype(np.uint64) << np.uint64(_TOKEN_BITS) | token
        packed.sort()
        if len(packed):
            packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
        yield first, len(offsets) - 1, packed


def _set_keys(packed: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and key of each text, and the first token of each: the key is a hash of the sums of two token hashes."""
    doc = (packed >> np.uint64(_TOKEN_BITS)).astype(np.int64)
    size = np.bincount(doc, minlength=n_texts)
    head = np.searchsorted(doc, np.arange(n_texts))
    key = size.astype(np.uint64)
    filled = np.flatnonzero(size)
    if len(filled):
        token = packed & np.uint64(_TOKEN)
        for salt in (0x51ED2701, 0xA24BAED5):
            sums = np.add.reduceat(textbytes.mix(token + (np.uint64(salt) << np.uint64(_TOKEN_BITS - 16))), head[filled])
            key[filled] = textbytes.mix(key[filled] * textbytes.BASE + sums)
    return size, key.view(np.int64), head


def _sizes(words: int):
    def sizes(texts: pa.Array) -> pa.Array:
        n, key = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for first, count, packed in shingle_sets(texts, words):
            size, keys, _ = _set_keys(packed, count)
            n[first : first + count], key[first : first + count] = size, keys
        textbytes.give_back()
        return pa.StructArray.from_arrays([pa.array(n), pa.array(key, mask=n == 0)], names=["n", "key"])

    return sizes


def _token_bytes(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _tokens_of(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _dealt(parts: int, words: int):
    """Packs (set, token) pairs by part: a token's own part, or, for frequent tokens, a part of the set's."""

    def rows(part: np.ndarray, key: np.ndarray, token: np.ndarray, flagged: bool) -> pa.RecordBatch | None:
        if not len(part):
            return None
        order = np.lexsort((key, part))
        part, key, token = part[order], key[order], token[order]
        new_set = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])]
        set_at = np.flatnonzero(new_set)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        count = np.diff(np.r_[set_at, len(part)]).astype(np.uint32)
        set_cut = np.searchsorted(set_at, np.r_[cut, len(part)])
        ends = np.r_[cut[1:], len(part)]
        keys = [key[set_at[a:b]].tobytes() for a, b in zip(set_cut[:-1], set_cut[1:])]
        counts = [count[a:b].tobytes() for a, b in zip(set_cut[:-1], set_cut[1:])]
        tokens = [_token_bytes(token[a:b]) for a, b in zip(cut, ends)]
        columns = [pa.array(part[cut], pa.int64()), pa.array(np.full(len(cut), flagged)), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(tokens, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "flagged", "keys", "counts", "tokens"])

    def emit(keys: list[np.ndarray], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, token = np.concatenate(keys), np.concatenate(tokens)
        ordered = np.sort(token)
        head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        often = ordered[head][np.diff(np.r_[head, len(ordered)]) >= FREQUENT]
        frequent = np.isin(token, often) if len(often) else np.zeros(len(token), bool)
        own = (token % np.uint64(parts)).astype(np.int64)
        theirs = parts + (key.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        usual = ~frequent
        for batch in (
            rows(own[usual], key[usual], token[usual], False),
            rows(theirs[frequent], key[frequent], token[frequent], False),
            rows((often % np.uint64(parts)).astype(np.int64), np.zeros(len(often), np.int64), often, True),
        ):
            if batch is not None:
                yield batch

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tokens, held, met = [], [], 0, set()
        for batch in batches:
            for _, count, packed in shingle_sets(batch["text"], words):
                size, key, head = _set_keys(packed, count)
                for i in np.flatnonzero(size):
                    if key[i] in met:
                        continue  # an equal set is in the buffer already
                    met.add(int(key[i]))
                    keys.append(np.full(size[i], key[i]))
                    tokens.append(packed[head[i] : head[i] + size[i]] & np.uint64(_TOKEN))
                    held += int(size[i])
                    if held >= BUFFER_TOKENS:
                        yield from emit(keys, tokens)
                        keys, tokens, held, met = [], [], 0, set()
        if held:
            yield from emit(keys, tokens)
        textbytes.give_back()

    return deal


def _shared_tokens(parts: int):
    """Of one part: the tokens that several sets have, by set, each with the number of sets in its top bits."""

    def shared(table: pa.Table) -> pa.Table:
        flagged = table["flagged"].to_numpy(zero_copy_only=False)
        keys, tokens, often = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for is_flag, k, c, t in zip(flagged, table["keys"].to_pylist(), table["counts"].to_pylist(), table["tokens"].to_pylist()):
            if is_flag:
                often.append(_tokens_of(t))
            else:
                keys.append(np.repeat(np.frombuffer(k, np.int64), np.frombuffer(c, np.uint32)))
                tokens.append(_tokens_of(t))
        key, token = np.concatenate(keys), np.concatenate(tokens)
        order = np.lexsort((key, token))
        key, token = key[order], token[order]
        keep = np.r_[True, (key[1:] != key[:-1]) | (token[1:] != token[:-1])][: len(key)]
        key, token = key[keep], token[keep]
        if table["part"][0].as_py() >= parts:
            rank = np.full(len(token), _LAST_CLASS, np.uint64)
        else:
            head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
            times = np.diff(np.r_[head, len(token)])
            rank = np.repeat(np.minimum(times, _LAST_CLASS - 1), times).astype(np.uint64)
            rank[np.isin(token, np.concatenate(often))] = _LAST_CLASS
        textbytes.give_back()
        several = rank >= 2
        key, value = key[several], (rank[several] << np.uint64(_TOKEN_BITS) | token[several]).view(np.int64)
        return pa.table({"key": pa.array(key, pa.int64()), "token": pa.array(value, pa.int64())})

    return shared


def _least_share(n: Column, percent: int) -> Column:
    """ceil(t n): what a set of n must share with a linked one at least."""
    return F.ceil((n * percent + 0.0) / 100).cast("int")


def _need(n1: Column, n2: Column, percent: int) -> Column:
    """Shingles that sets of these sizes share at least if they are linked: ceil(t (n1 + n2) / (1 + t))."""
    return F.ceil(((n1 + n2) * percent + 0.0) / (100 + percent)).cast("int")


def set_links(sets: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, root) of the sets that are linked with others; ``sets`` has n and key, ``texts`` the texts they stem from."""
    total = sets.agg(F.sum("n").alias("n")).first().n or 0
    parts = max(1, -(-total // PART_TOKENS))
    dealt = texts.mapInArrow(_dealt(parts, words), "part long, flagged boolean, keys binary, counts binary, tokens binary")
    shared = dealt.groupBy("part").applyInArrow(_shared_tokens(parts), "key long, token long")
    by_set = shared.groupBy("key").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    sizes = sets.where("n > 0").groupBy("key").agg(F.max("n").cast("int").alias("n"))
    n, own = F.col("n"), F.col("n") - F.size("tokens")
    alive = by_set.where(F.size("tokens") > 0).join(sizes, "key").where(F.size("tokens") >= _least_share(n, percent))
    length = n - _least_share(n, percent) + 1 - own

    def prefix(salt: int) -> Column:
        return F.slice(F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(salt)))), F.lit(1), length)

    alive = settled(alive.select("key", "n", own.alias("own"), "tokens", length.alias("length"), prefix(2).alias("second"), prefix(3).alias("third")))
    first_order = alive.select("key", "n", "own", F.posexplode(F.slice("tokens", F.lit(1), F.col("length"))).alias("i", "token"))
    in_bucket = first_order.select("key", "n", "token", (F.col("own") + F.col("i")).alias("place"))
    count = Window.partitionBy("token")
    central = F.row_number().over(count.orderBy(F.col("place") / F.col("n"), "key"))
    buckets = settled(in_bucket.withColumn("members", F.count(F.lit(1)).over(count)).where("members > 1").withColumn("rank", central).drop("members"))
    if buckets.isEmpty():
        return buckets.select("key", F.col("key").alias("root")).limit(0)
    roots = alive.select("key", F.col("key").alias("root"))
    low = 0
    for high in (*HUBS, None):
        members = buckets.join(roots, "key")
        if high is not None:
            hubs = members.where((F.col("rank") > low) & (F.col("rank") <= high))
            low = high
        else:  # all members outside the largest class of their bucket
            per_class = members.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
            major = per_class.groupBy("token").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("classes"))
            mixed = major.where("classes > 1").select("token", F.col("m.root").alias("major"))
            members = members.join(mixed, "token")
            hubs = members.where("root <> major").drop("major")
        links = _verified(_candidates(members, hubs, percent), alive, percent)
        joined = components(links.join(_named(roots, "x"), "x").join(_named(roots, "y"), "y").select(F.col("root_x").alias("a"), F.col("root_y").alias("b")))
        renamed = joined.select(F.col("node").alias("root"), F.col("root").alias("new_root"))
        roots = settled(roots.join(renamed, "root", "left").select("key", F.coalesce("new_root", "root").alias("root")))
    return roots


def _named(roots: DataFrame, side: str) -> DataFrame:
    return roots.select(F.col("key").alias(side), F.col("root").alias(f"root_{side}"))


def _candidates(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x, y) of members and hubs of one bucket, of different classes, whose places allow a link."""
    left, right = members.alias("l"), hubs.alias("r")
    left_over = F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place"))
    fits = left_over >= _need(F.col("l.n"), F.col("r.n"), percent)
    pairs = left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.root") != F.col("r.root")) & fits)
    return pairs.select(F.least("l.key", "r.key").alias("x"), F.greatest("l.key", "r.key").alias("y")).distinct()


def _verified(pairs: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """The pairs whose second and third prefixes overlap too and whose sets are similar enough."""
    def side(name: str) -> DataFrame:
        return alive.select(F.col("key").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "tokens", "second", "third")))

    both = pairs.join(side("x"), "x").join(side("y"), "y")
    both = both.where(F.arrays_overlap("second_x", "second_y") & F.arrays_overlap("third_x", "third_y"))
    shared = F.size(F.array_intersect("tokens_x", "tokens_y"))
    return settled(both.where(100 * shared >= percent * (F.col("n_x") + F.col("n_y") - shared)).select("x", "y"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: the id, n_shingles (set size) and component_id (the smallest id reachable by links).

    Two texts are linked if their sets of ``words``-word shingles have a similarity of ``percent`` hundredths or more.
    Repeated rows come back as often. A null or empty text, or one of white space only, has no shingles and is linked
    with nothing: its component is its own id. A null id never names a component that has another id. Sets are told
    apart by 64-bit keys and shingles by 48-bit tokens. Columns other than id and text are ignored. Nothing but counts
    reaches the driver.
    """
    sized = F.arrow_udf(_sizes(words), "n long, key long")
    texts = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    sets = documents.select(F.col(id_col).alias("id"), sized(F.col(text)).alias("s")).select("id", "s.n", "s.key")
    sets = settled(sets)
    roots = set_links(sets, texts, words, percent).withColumnRenamed("key", "root_key")
    classed = sets.join(roots, sets["key"] == roots["root_key"], "left").select("id", "n", "key", F.coalesce("root", "key").alias("class"))
    least = classed.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("least")).withColumnRenamed("class", "class2")
    named = classed.join(least, classed["class"] == least["class2"], "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents`` whose id is the smallest of its component; rows that share an id are one document.

    An id with several texts stays if one of them does, and rows without an id stay. The ids that go are broadcast up to
    ``BROADCAST_ROWS``, and joined by a shuffle beyond.
    """
    found = near_duplicates(documents, id_col, words=words, percent=percent)
    gone = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min((F.col(id_col) != F.col("component_id")).cast("int")).alias("gone"))
    gone = settled(gone.where("gone = 1").select(id_col))
    return documents.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, id_col, "left_anti").select(documents.columns)
