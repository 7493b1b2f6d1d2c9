"""Toxicity: a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report. The insult symbols come from a lexicon of words and word
beginnings that is learnt from labelled texts; the others are closed word lists. A word enters the lexicon by the clauses in
which it is neither negated nor reported, so an insult that clean texts quote or deny is one all the same; a word that is
harmless by itself may enter for the clauses in which it has a target. Five transducers read the symbols of a
clause in turn, each passing its output to the next:

  negation   marks what follows a negating word within ``REACH`` words,
  report     marks what follows a verb of saying, up to the end of the clause,
  target     marks what has a person word within ``REACH`` words before it,
  threat     turns a target word followed by a threatening verb (or the reverse) into a threat,
  insult     turns insults into matches.

A match carries its lexicon weight and the marks it has gathered. How much a set of marks changes the odds of a match is
learnt too, from texts that no unmarked match explains (``MARK_PRIOR`` rows of evidence keep the hand-set factors where the
sample says little). A text's score is the
noisy-or of its matched clauses, so words outside a matched clause count for nothing.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import samples, textbytes

#: Labelled rows used for training, about; see ``samples.bounded``.
SAMPLE_ROWS = 16_384
THRESHOLD = 0.5
REACH = 4
#: A lexicon entry must explain this many toxic texts that no earlier entry explains; and this share of the texts that have
#: it, neither negated nor reported, must be toxic. A word in ``COMMON_SHARE`` of the toxic texts need not explain new ones,
#: nor need a word beginning that also has the precision ``SURE``.
LEAST_NEW, LEAST_PRECISION, COMMON_SHARE, SURE = 3, 0.97, 0.03, 0.99
#: Lengths in bytes of the word beginnings that may enter the lexicon.
PREFIXES = (4, 5, 6, 7, 8)
#: Added to the length of an entry that counts only where the word has a target.
TARGET_ONLY = 16
MARK_PRIOR = 4.0
NEGATED, REPORTED, TARGETED = 1, 2, 4
#: Hand-set factors on the odds of a match, by mark.
MARK_FACTORS = {NEGATED: 0.4, REPORTED: 0.5, TARGETED: 1.5}
THREAT_WEIGHT = 0.6

INSULT, THREAT, TARGET, NEGATION, REPORT = range(1, 6)
_WORD_LISTS = {
    NEGATION: "not never no isn't without nicht nie kein keine ohne pas jamais sans aucun no nunca sin ningún",
    REPORT: "said says say wrote writes called calls quoted claims claimed sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó",
    TARGET: "you your you're he she they them him her his their du dich ihr sie er tu vous toi elle ils tú usted él ella ellos",
    THREAT: "kill hurt destroy burn shoot stab attack töten verletzen zerstören tuer blesser détruire matar herir destruir",
}
_ALNUM = textbytes.runs_of("alnum")
_CLAUSE_END = np.isin(np.arange(256), [ord(c) for c in ".!?;:\n"])


@lru_cache(maxsize=1)
def closed_words() -> dict[int, int]:
    """Entry code of a whole word to symbol."""
    out = {}
    for symbol, listed in _WORD_LISTS.items():
        for word in re.findall(r"[^\W_]+", listed):
            out.setdefault(textbytes.word_hash(word.encode()) >> SLICE_BITS, symbol)
    return out


@dataclass
class Grammar:
    """What training gives: entry codes with their precision by length (0: whole words, see ``TARGET_ONLY``), odds factors by marks, base rate."""

    entries: dict[int, dict[int, float]] = field(default_factory=dict)
    factors: dict[int, float] = field(default_factory=lambda: {m: _prior_factor(m) for m in range(8)})
    base: float = 0.02


def _prior_factor(marks: int) -> float:
    return float(np.prod([f for m, f in MARK_FACTORS.items() if marks & m]))


#: Texts of one slice are numbered with this many bits; the other bits of a word hash are the entry's code.
SLICE_BITS = 22


def entry_codes(w: textbytes.Words, length: int) -> np.ndarray:
    """Codes of the words' beginnings of this many bytes, or of the whole words if it is 0."""
    length %= TARGET_ONLY
    return (w.hashes() if length == 0 else w.prefix_hashes(length)) >> np.uint64(SLICE_BITS)


class _Lookup:
    """Finds which of many hashes are in a table: a bitmap of 16 hash bits first, then the sorted table."""

    def __init__(self, table: dict[int, float]):
        self.keys = np.array(sorted(table), np.uint64)
        self.values = np.array([table[k] for k in sorted(table)], float)
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.bitmap[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], self.values[at[hit]]


def _closed() -> _Lookup:
    return _Lookup({k: float(v) for k, v in closed_words().items()})


def _clauses(data: np.ndarray) -> np.ndarray:
    """Number of clause ends before each byte."""
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLAUSE_END[data], out=ends[1:])
    return ends


def contexts(data: np.ndarray, w: textbytes.Words, closed: _Lookup) -> np.ndarray:
    """The marks that the transducers would give each word, were it an insult."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64)
    clause, place = _clauses(data)[w.start], np.arange(n)
    kind = np.zeros(n, np.int64)
    at, value = closed(entry_codes(w, 0))
    kind[at] = value.astype(int)
    head = np.r_[True, (clause[1:] != clause[:-1]) | (w.doc[1:] != w.doc[:-1])]
    first = np.maximum.accumulate(np.where(head, place, 0))

    def since(symbol: int) -> np.ndarray:
        """Words since the last such word of the clause; more than the slice has, if there is none."""
        seen = np.maximum.accumulate(np.where(kind == symbol, place, -1))
        before = np.r_[-1, seen[:-1]]
        return np.where(before >= first, place - before, n + REACH + 1)

    return NEGATED * (since(NEGATION) <= REACH) + REPORTED * (since(REPORT) <= n) + TARGETED * (since(TARGET) <= REACH)


def symbols(data: np.ndarray, offsets: np.ndarray, lookups: dict[int, _Lookup], closed: _Lookup):
    """Symbols of a slice in order: (text, clause, word, symbol, weight) arrays; words without a symbol are left out."""
    data = textbytes.fold_case(data)
    w = textbytes.words(data, offsets, _ALNUM)
    weight = np.zeros(len(w.start))
    marks = contexts(data, w, closed) if max(lookups, default=0) >= TARGET_ONLY else None
    for length, lookup in lookups.items():
        at, value = lookup(entry_codes(w, length))
        if length >= TARGET_ONLY:
            aimed = marks[at] & TARGETED > 0
            at, value = at[aimed], value[aimed]
        weight[at] = np.maximum(weight[at], value)
    kind = np.where(weight > 0, INSULT, 0)
    at, value = closed(entry_codes(w, 0))
    kind[at] = np.where(kind[at] == 0, value.astype(int), kind[at])
    marked = np.flatnonzero(kind)
    return w.doc[marked], _clauses(data)[w.start[marked]], marked, kind[marked], weight[marked]


def negation(stream: Iterator) -> Iterator:
    until = -1
    for word, kind, weight, marks in stream:
        if kind == NEGATION:
            until = word + REACH
        else:
            yield word, kind, weight, marks | (NEGATED if word <= until else 0)


def report(stream: Iterator) -> Iterator:
    said = False
    for word, kind, weight, marks in stream:
        if kind == REPORT:
            said = True
        else:
            yield word, kind, weight, marks | (REPORTED if said else 0)


def target(stream: Iterator) -> Iterator:
    until = -1
    for word, kind, weight, marks in stream:
        if kind == TARGET:
            until = word + REACH
        yield word, kind, weight, marks | (TARGETED if kind != TARGET and word <= until else 0)


def threat(stream: Iterator) -> Iterator:
    verb = person = None
    for word, kind, weight, marks in stream:
        if kind == TARGET:
            person = word
            if verb is not None and word - verb[0] <= REACH:
                yield word, INSULT, THREAT_WEIGHT, verb[1] | TARGETED
                verb = None
        elif kind == THREAT:
            verb = (word, marks)
            if person is not None and word - person <= REACH:
                yield word, INSULT, THREAT_WEIGHT, marks | TARGETED
                verb = None
        else:
            yield word, kind, weight, marks


def matches(clause: list[tuple[int, int, float]]) -> list[tuple[float, int]]:
    """(weight, marks) of the matches of one clause, given the (word, symbol, weight) triples in order."""
    stream = ((word, kind, weight, 0) for word, kind, weight in clause)
    for transducer in (negation, report, target, threat):
        stream = transducer(stream)
    return [(weight, marks) for _, kind, weight, marks in stream if kind == INSULT]


def matched_texts(texts: pa.Array, grammar: Grammar) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(number, matches) of the texts that have any."""
    lookups = {n: _Lookup(t) for n, t in grammar.entries.items() if t}
    closed = _closed()
    for first, data, offsets in textbytes.slices(texts):
        doc, clause, word, kind, weight = symbols(data, offsets, lookups, closed)
        if not len(doc):
            continue
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (clause[1:] != clause[:-1])])
        worth = np.maximum.reduceat((kind == INSULT) | (kind == THREAT), head)
        found: dict[int, list[tuple[float, int]]] = {}
        for a, b in zip(head[worth], np.r_[head[1:], len(doc)][worth]):
            if got := matches(list(zip(word[a:b].tolist(), kind[a:b].tolist(), weight[a:b].tolist()))):
                found.setdefault(first + int(doc[a]), []).extend(got)
        yield from found.items()


def probability(got: list[tuple[float, int]], grammar: Grammar) -> float:
    clean = 1 - grammar.base
    for weight, marks in got:
        odds = weight / max(1e-9, 1 - weight) * grammar.factors[marks]
        clean *= 1 / (1 + odds)
    return 1 - clean


_LENGTHS = [n + only for only in (0, TARGET_ONLY) for n in (0, *PREFIXES)]


def _counts(size: np.ndarray, marks: np.ndarray, length: int) -> np.ndarray:
    """Which words are evidence for entries of this length."""
    plain = (size > max(1, length % TARGET_ONLY)) & (marks & (NEGATED | REPORTED) == 0)
    return plain & (marks & TARGETED > 0) if length >= TARGET_ONLY else plain


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, entry, toxic) for every distinct word and word beginning that a text has, neither negated nor reported;
    once more for those with a target."""
    closed = _closed()
    for batch in batches:
        toxic = np.asarray(batch["label"].to_numpy(zero_copy_only=False)) == 1
        for first, data, offsets in textbytes.slices(batch["text"]):
            data = textbytes.fold_case(data)
            w = textbytes.words(data, offsets, _ALNUM)
            size, marks = w.end - w.start, contexts(data, w, closed)
            texts, number = np.unique(w.doc, return_inverse=True)  # fewer than the bytes of a slice
            for length in _LENGTHS:
                ok = _counts(size, marks, length)
                entry = entry_codes(w, length)[ok]
                pair = np.unique(entry << np.uint64(SLICE_BITS) | number[ok].astype(np.uint64))
                doc = texts[(pair & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64)]
                entry = (pair >> np.uint64(SLICE_BITS)).astype(np.int64)
                columns = [pa.array(np.full(len(doc), length), pa.int32()), pa.array(entry), pa.array(toxic[first + doc])]
                yield pa.RecordBatch.from_arrays(columns, names=["length", "entry", "toxic"])


def train(labelled: DataFrame) -> Grammar:
    """Grammar from (text, label 0/1) rows; rows with a null label are left out, a null text has no words.

    ``labelled`` should be a bounded sample (``samples.labelled_texts``): the candidate entries of its toxic texts and the
    matches of its texts reach the driver. Without toxic rows the lexicon is empty and every text gets the base rate.
    """
    rows = labelled.where(F.col("label").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    rows = rows.distinct().withColumn("key", F.xxhash64("text"))  # copies of one text are one piece of evidence
    schema = "length int, entry long, toxic boolean"
    counted = rows.mapInArrow(_entry_rows, schema).groupBy("length", "entry").agg(
        F.sum(F.col("toxic").cast("long")).alias("bad"), F.count(F.lit(1)).alias("texts")
    )
    likely = counted.where((F.col("bad") >= LEAST_NEW) & (F.col("bad") >= LEAST_PRECISION * F.col("texts"))).toPandas()
    grammar = Grammar()
    if not len(likely):
        return grammar
    likely["weight"] = (likely["bad"] + 0.5) / (likely["texts"] + 1.0)
    tables = {int(n): dict(zip(part["entry"].tolist(), part["weight"])) for n, part in likely.groupby("length")}
    chosen = _cover(rows.where("label = 1"), tables)
    for length, entry in chosen:
        grammar.entries.setdefault(length, {})[entry] = float(tables[length][entry])
    marks = rows.mapInArrow(lambda b: _mark_rows(b, grammar), "marks int, weight double, toxic boolean").groupBy("marks").agg(
        F.sum(F.col("toxic").cast("long")).alias("bad"), F.count(F.lit(1)).alias("texts"), F.avg("weight").alias("weight")
    )
    for found in marks.collect():  # eight rows at most
        grammar.factors[found["marks"]] = learnt_factor(found["marks"], found["bad"], found["texts"], found["weight"])
    return grammar


def learnt_factor(marks: int, bad: int, texts: int, weight: float) -> float:
    """What these marks multiply the odds of a match by: the odds of the texts that have such matches at best, by the odds
    that their mean weight promises, with ``MARK_PRIOR`` more texts that keep to the hand-set factor."""
    promised = weight / max(1e-9, 1 - weight)
    expected = promised * _prior_factor(marks)
    share = (bad + MARK_PRIOR * expected / (1 + expected)) / (texts + MARK_PRIOR)
    return share / max(1e-6, 1 - share) / max(1e-9, promised)


def _cover(toxic: DataFrame, tables: dict[int, dict[int, float]]) -> list[tuple[int, int]]:
    """Entries that explain the toxic texts, greedily: the one in most texts not explained yet comes next."""
    lookups, closed = {n: _Lookup(t) for n, t in tables.items()}, _closed()

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy()
            for first, data, offsets in textbytes.slices(batch["text"]):
                data = textbytes.fold_case(data)
                w = textbytes.words(data, offsets, _ALNUM)
                size, marks = w.end - w.start, contexts(data, w, closed)
                for length, lookup in lookups.items():
                    entry = entry_codes(w, length)
                    at, _ = lookup(entry)
                    at = at[_counts(size[at], marks[at], length)]
                    columns = [pa.array(keys[first + w.doc[at]]), pa.array(np.full(len(at), length), pa.int32()), pa.array(entry[at].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "length", "entry"])

    found = toxic.mapInArrow(hits, "doc long, length int, entry long").distinct().toPandas()
    texts_of: dict[tuple[int, int], set[int]] = {}
    for (length, entry), part in found.groupby(["length", "entry"])["doc"]:
        texts_of[int(length), int(entry)] = set(part)
    n = found["doc"].nunique()
    chosen = [e for e, t in texts_of.items() if len(t) >= max(LEAST_NEW, COMMON_SHARE * n) and (e[0] % TARGET_ONLY == 0 or tables[e[0]][e[1]] >= SURE)]
    explained = set().union(*(texts_of[e] for e in chosen))
    texts_of = {e: rest for e, t in texts_of.items() if len(rest := t - explained) >= LEAST_NEW}
    while texts_of:
        # entries without a condition first, whole words before beginnings, longer beginnings before shorter ones, when they explain as much
        best = max(texts_of, key=lambda e: (len(texts_of[e]), e[0] < TARGET_ONLY, e[0] % TARGET_ONLY == 0, e[0], e[1]))
        new = texts_of.pop(best)
        if len(new) < LEAST_NEW:
            break
        chosen.append(best)
        texts_of = {e: rest for e, t in texts_of.items() if len(rest := t - new) >= LEAST_NEW}
    return chosen


def _mark_rows(batches: Iterator[pa.RecordBatch], grammar: Grammar) -> Iterator[pa.RecordBatch]:
    """(marks, largest weight, toxic) per text and set of marks; where a match is neither negated nor reported, it alone is evidence."""
    for batch in batches:
        toxic = batch["label"].to_numpy(zero_copy_only=False) == 1
        rows = []
        for i, got in matched_texts(batch["text"], grammar):
            plain = [m for m in got if not m[1] & (NEGATED | REPORTED)]
            best: dict[int, float] = {}
            for weight, marks in plain or got:
                best[marks] = max(weight, best.get(marks, 0.0))
            rows += [(marks, weight, bool(toxic[i])) for marks, weight in best.items()]
        frame = pd.DataFrame(rows, columns=["marks", "weight", "toxic"])
        columns = [pa.array(frame["marks"], pa.int32()), pa.array(frame["weight"], pa.float64()), pa.array(frame["toxic"], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["marks", "weight", "toxic"])


def score(text: str | Column, grammar: Grammar) -> Column:
    """Probability of label 1; null and empty texts, and texts without a matched clause, get the base rate."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(grammar)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = np.full(len(texts), shared.value.base)
        for i, got in matched_texts(texts, shared.value):
            out[i] = probability(got, shared.value)
        textbytes.give_back()
        return pa.array(out)

    return scored(text)


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, modulus: int = 5, rest: int = 0) -> DataFrame:
    """``documents`` with held_out, score (0 to 1) and predicted (1 if score >= ``THRESHOLD``).

    Labels are learnt from ``labels`` (doc_id, label) rows outside the held-out remainder only. Every input row comes
    back once, repeated rows included; columns of the input named like the three are replaced.
    """
    usable = labels.where(F.col("label").isNotNull() & ~samples.is_held_out("doc_id", modulus, rest)).select("doc_id", "label")
    grammar = train(samples.labelled_texts(documents, usable, sample_rows))
    scored = documents.withColumn("held_out", samples.is_held_out("doc_id", modulus, rest)).withColumn("score", score("text", grammar))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
