"""Operators that SQL can't express, against brute force, the public library or held-out accuracy; and the edge cases."""
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import bpe, components, decontaminate, jaccard_join, language, line_dedup, pieces, quality, samples, suffix_array, suffix_dedup, textbytes, topk, toxicity
from cohortloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, score double, ids string, kept int, _id string"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with what the operators add."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 9.0, "own", 1, "own") for i, t in zip(ids, texts)], DOCS)


def words_of(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# --- helpers -----------------------------------------------------------------------------------


def test_word_hashes_depend_on_the_word_alone():
    texts = pa.array(["ab cd", None, "", "cd\tab x", "é ab"])
    found = []
    for _, data, offsets in textbytes.slices(texts):
        w = textbytes.words(data, offsets, textbytes.runs_of("nonspace"))
        found += [(int(d), bytes(data[a:b]).decode(), int(h)) for d, a, b, h in zip(w.doc, w.start, w.end, w.hashes())]
    assert [(d, x) for d, x, _ in found] == [(0, "ab"), (0, "cd"), (3, "cd"), (3, "ab"), (3, "x"), (4, "é"), (4, "ab")]
    assert all(h == textbytes.word_hash(x.encode()) for _, x, h in found)


@pytest.mark.parametrize("limit", [1, 7, 64, 1 << 20])
def test_slices_cover_all_texts(limit):
    rng = random.Random(1)
    texts = ["x" * rng.choice([0, 1, 5, 90]) for _ in range(200)]
    got = []
    for first, data, offsets in textbytes.slices(pa.array(texts), limit, most=50):
        assert first == len(got)
        got += [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == texts


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = rng.integers(0, rng.integers(1, 6), rng.integers(1, 80))
        text = s.tolist()
        expected = sorted(range(len(text)), key=lambda i: text[i:])
        for big in (0, 2000):  # both ways of inducing
            shifted = s if not big else np.r_[s + big]
            assert suffix_array.suffix_array(shifted).tolist() == expected
        got = suffix_array.common_prefixes(text, np.array(expected), 9)
        for a, b in zip(expected, expected[1:]):
            n = 0
            while n < 9 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert got[b] == n


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 207)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 quality, 8 toxicity, 6 language -----------------------------------------------------------


def test_quality_accuracy_on_held_out_rows(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.classify(d, labels.select("doc_id", F.col("quality").alias("label"))).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.93
    assert out.score.between(0, 1).all()


def test_held_out_rows_follow_the_checksum(spark):
    d = docs(spark, ["a"] * 50 + ["a"], [*range(50), None])
    no_labels = spark.createDataFrame([], "doc_id long, label int")
    rows = quality.classify(d, no_labels).collect()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.score == 0.5 and r.predicted == 0 for r in rows)  # nothing learnt


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifiers_take_odd_rows(spark, classify):
    texts = [None, "", " ", "x", "long " * 50_000, "fine words here", "fine words here"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(5, None), (None, 1), (5, 0)], "doc_id long, label int")
    out = classify(docs(spark, texts), labels).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.ids == "own" for r in out)
    assert classify(docs(spark, []), labels).count() == 0


def test_quality_does_not_depend_on_other_texts_of_a_batch():
    w = np.random.default_rng(0).normal(size=quality.DIM + 1).astype(np.float32)
    texts = ["One two three", "", "TWO!! TWO!! two", "a\nb|c"]
    together = quality.score_texts(pa.array(texts), w)
    alone = [quality.score_texts(pa.array([t]), w)[0] for t in texts]
    assert np.allclose(together, alone)


def test_toxicity_accuracy_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.classify(d, labels.select("doc_id", F.col("toxic").alias("label"))).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.toxic).mean() > 0.97


def test_grammar_marks():
    T, N, R, I, V = toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.INSULT, toxicity.THREAT
    assert toxicity.matches([(0, I, 0.9)]) == [(0.9, 0)]
    assert toxicity.matches([(0, N, 0.0), (2, I, 0.9)]) == [(0.9, toxicity.NEGATED)]
    assert toxicity.matches([(0, N, 0.0), (9, I, 0.9)]) == [(0.9, 0)]
    assert toxicity.matches([(0, R, 0.0), (9, I, 0.9)]) == [(0.9, toxicity.REPORTED)]
    assert toxicity.matches([(0, T, 0.0), (1, I, 0.9)]) == [(0.9, toxicity.TARGETED)]
    assert toxicity.matches([(0, V, 0.0), (1, T, 0.0)]) == [(toxicity.THREAT_WEIGHT, toxicity.TARGETED)]
    assert toxicity.matches([(0, V, 0.0), (30, T, 0.0)]) == []


def test_language_accuracy_and_undetermined_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, "12 ... 34", None), (10**6 + 3, "€€ ☃", None)], "doc_id long, text string, lang string")
    out = language.identify(d.select("doc_id", "text", "lang").unionByName(odd)).toPandas()
    held = out[out.held_out & (out.doc_id < 10**6)]
    assert (held.lang_pred == held.lang).mean() > 0.96
    assert (out[out.doc_id >= 10**6].lang_pred == "und").all()
    assert out.score.between(0, 1).all()


def test_mixture_shares():
    rng = np.random.default_rng(2)
    own = rng.random(900) < 0.3
    logs = [np.where(own, -1.0, -9.0), np.where(own, -9.0, -1.0), np.full(900, -7.0)]
    shares = language.mixtures(logs, np.zeros(900, np.int64), 1)[0]
    assert abs(shares[0] - own.mean()) < 0.01 and shares[2] == 0
    pure = language.mixtures([np.full(50, -1.0), np.full(50, -3.0)], np.zeros(50, np.int64), 1)[0]
    assert pure.tolist() == [1.0, 0.0]


def test_a_rare_language_has_a_model_at_every_size(spark):
    rng = random.Random(12)
    common = [f"the house and the {words_of(rng, 6)} garden were quiet this morning" for _ in range(3000)]
    rare = [f"þetta hús og garðurinn {w} voru hljóð í morgun" for w in ("hér", "þar", "nú", "samt")]
    rows = [(None if i % 2 else 4 * i, x, "en") for i, x in enumerate(common)] + [(None, x, "is") for x in rare]
    rows += [(None, "the same row again", "en")] * 2000
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.text: r.lang_pred for r in language.identify(d, sample_rows=200).where("lang = 'is'").collect()}
    assert out == dict.fromkeys(rare, "is")
    picked = samples.bounded_by(d, "lang", ["doc_id", "text"], 200, 64).collect()
    assert sum(r.lang == "is" for r in picked) == 4 and 50 < sum(r.lang == "en" for r in picked) < 400


def test_language_without_training_rows(spark):
    d = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert language.identify(d).first().lang_pred == "und"


# --- 3 byte pairs --------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    known = Tokenizer.from_file(path)
    rng = random.Random(4)
    signs = "abcXYZ '.,!?-_0159éÉßİΣς日本語ﬁǅ½²́​ \x1c\x85\n\t😀<|>"
    texts = ["", None, "don't I'VE we'll''s", "<|endoftext|>a<|startoftext|>", "<|endoftext|", "x" * 3000, "ΑΣ ΟΔΟΣ", "a" + "́" * 40]
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(300)]
    rows = {r.doc_id: r for r in bpe.round_trip(docs(spark, texts), path).collect()}
    for i, text in enumerate(texts):
        expected = known.encode(text or "", add_special_tokens=False).ids
        assert list(rows[i].ids) == expected, text
        assert rows[i].decoded == known.decode(expected, skip_special_tokens=False)
    assert bpe.round_trip(docs(spark, []), path).count() == 0


def test_bpe_cache_starts_anew():
    v = bpe.Vocabulary(tokenizer_path())
    expected = [v.encode(f"word{i} and more") for i in range(50)]
    v.room = -1
    assert [v.encode(f"word{i} and more") for i in range(50)] == expected


# --- 5 repeated strings --------------------------------------------------------------------------


def brute_force_removed(texts):
    seen, out = {}, []
    for i, text in enumerate(texts):
        raw, gone = (text or "").encode(), set()
        for p in range(len(raw) - 99):
            window = raw[p : p + 100]
            if seen.setdefault(window, (i, p)) != (i, p):
                gone.update(range(p, p + 100))
        out.append(bytes(b for k, b in enumerate(raw) if k not in gone))
    return out


def repeating_texts(seed):
    rng = random.Random(seed)
    shared = [words_of(rng, n) for n in (20, 40, 200)]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101, "ab" * 400, "é" * 120, "xé" * 90]
    for _ in range(40):
        texts.append(" ".join(rng.choice([words_of(rng, 30), rng.choice(shared), rng.choice(shared)[: rng.randint(50, 400)], "z " * rng.randint(1, 90)]) for _ in range(rng.randint(1, 5))))
    return texts + [texts[-1], texts[20] + "tail", "head" + texts[20]]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings_equal_brute_force(spark, seed, monkeypatch):
    texts = repeating_texts(seed)
    monkeypatch.setattr(suffix_dedup, "PART_PIECES", 40)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    rows = {r.doc_id: r for r in suffix_dedup.dedup(docs(spark, texts).drop("kept")).collect()}
    for i, expected in enumerate(brute_force_removed(texts)):
        assert bytes(rows[i].kept) == expected, i
        spans = rows[i].removed
        assert all(a.start + a.length < b.start for a, b in zip(spans, spans[1:]))
        assert sum(s.length for s in spans) == len((texts[i] or "").encode()) - len(expected)


def test_repeated_rows_and_null_ids_of_strings(spark):
    long = words_of(random.Random(9), 60)
    rows = suffix_dedup.dedup(docs(spark, [long, long, long, "short"], [7, 7, None, None])).collect()
    kept = sorted((r.doc_id is None, bytes(r.kept).decode()) for r in rows)
    assert kept == [(False, long), (False, long), (True, ""), (True, "short")]
    assert suffix_dedup.dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("frequent, group", [(4, 10**9), (10**9, 5), (6, 5)])
def test_an_anchor_with_many_pieces_is_split(spark, frequent, group, monkeypatch):
    rng = random.Random(5)
    passage, ends = words_of(rng, 60, 10**6), [words_of(rng, 12, 10**6) for _ in range(3)]
    texts = [f"{words_of(rng, 25, 10**6)} {passage} {rng.choice(ends)[: rng.randint(0, 60)]} {words_of(rng, 20, 10**6)}" for _ in range(80)]
    texts += [texts[5], texts[9][:-7], "ab" * 200, "xab" * 90 + passage]
    rng.shuffle(texts)
    sort_shard, most = suffix_dedup._sort_shard, min(frequent * 8, group)

    def watched(table: pa.Table) -> pa.Table:
        pieces_of = np.unique(table["anchor"].to_numpy(), return_counts=True)[1]
        assert pieces_of.max() <= most, f"{pieces_of.max()} pieces of one anchor in one shard"
        return sort_shard(table)

    monkeypatch.setattr(suffix_dedup, "_sort_shard", watched)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent, raising=False)
    monkeypatch.setattr(suffix_dedup, "GROUP_PIECES", group, raising=False)
    monkeypatch.setattr(suffix_dedup, "BUFFER_WINDOWS", 700, raising=False)
    monkeypatch.setattr(suffix_dedup, "PART_WINDOWS", 900, raising=False)
    monkeypatch.setattr(suffix_dedup, "PART_PIECES", 40)
    rows = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(docs(spark, texts).repartition(5)).collect()}
    for i, expected in enumerate(brute_force_removed(texts)):
        assert rows[i] == expected, i


def test_equal_windows_lie_in_pieces_of_one_anchor():
    rng = random.Random(8)
    common = words_of(rng, 80)
    anchors = {}
    for text in (words_of(rng, 50) + common + words_of(rng, 9), common[7:] + words_of(rng, 60)):
        raw = np.frombuffer(text.encode(), np.uint8)
        p = pieces.cut(raw, np.array([0, len(raw)]))
        assert p.windows.sum() == len(raw) - 99 and p.windows.max() <= pieces.ANCHORS
        for start, n, anchor in zip(p.start, p.windows, p.anchor):
            for q in range(start, start + n):
                assert anchors.setdefault(raw[q : q + 100].tobytes(), anchor) == anchor


# --- 10 near copies ------------------------------------------------------------------------------


def brute_force_components(texts):
    sets = []
    for text in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components_equal_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    texts = [None, "", "  ", "one", "One", "a b c", "a b c", "a b c d"]
    bases = [words_of(rng, rng.randint(20, 120), 5000).split() for _ in range(6)]
    line = words_of(rng, 25, 5000)
    for _ in range(90):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w) + (f" {line}" if rng.random() < 0.3 else ""))
    monkeypatch.setattr(jaccard_join, "FREQUENT", 12)
    monkeypatch.setattr(jaccard_join, "PART_TOKENS", 700)
    monkeypatch.setattr(jaccard_join, "BUFFER_TOKENS", 900)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(spark, texts)).collect()}
    for i, expected in enumerate(brute_force_components(texts)):
        assert rows[i] == expected, (i, texts[i])
    kept = {r.doc_id for r in jaccard_join.keep_one(docs(spark, texts)).collect()}
    assert kept == {i for i, (_, c) in rows.items() if c == i}


def test_jaccard_null_ids_and_empty_table(spark):
    rows = jaccard_join.near_duplicates(docs(spark, ["p q r s t", "p q r s t", "solo text of five words", ""], [None, 4, None, 9])).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (None, 2, None), (9, 0, 9)], key=str)
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


# --- 2 benchmark, 7 lines, 9 top k ---------------------------------------------------------------


def brute_force_hits(texts, items):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    spans = [(name, tuple(w[i : i + 13])) for name, t in items if (w := cut(t)) for i in range(max(1, len(w) - 12))]
    out = []
    for t in texts:
        w, hit, names = cut(t), set(), set()
        for name, s in spans:
            for p in range(len(w) - len(s) + 1):
                if tuple(w[p : p + len(s)]) == s:
                    hit.update(range(p, p + len(s)))
                    names |= {str(name)} if name is not None else set()
        out.append((len(w), len(hit), sorted(names)))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(i, words_of(rng, n, 60)) for i, n in enumerate([30, 13, 14, 12, 5, 1, 40])] + [(77, None), (78, ""), (None, "Ünique ΑΣ Item"), (6, words_of(rng, 20, 60)), (9, "same " * 30)]
    texts = [None, "", "ünique ασ item", "x Ünique-ΑΣ.ITEM'y", "same " * 50]
    for _ in range(60):
        parts = [words_of(rng, rng.randint(0, 40), 60)]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += [rng.choice([" ", ", "]).join(w[a:]).upper(), words_of(rng, rng.randint(0, 10), 60)]
        texts.append(" ".join(parts))
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, mark int")
    rows = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs(spark, texts), benchmark).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_force_hits(texts, items)


def test_clean_keeps_clean_rows(spark):
    passage = words_of(random.Random(3), 20)
    d = docs(spark, ["nothing here", passage, passage, None], [1, 2, 2, None])
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted((r.doc_id or 0) for r in decontaminate.clean(d, benchmark).collect()) == [0, 1]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(d, none).count() == 4
    assert decontaminate.contamination(docs(spark, []), benchmark).count() == 0


def test_lines_keep_the_first_occurrence(spark):
    d = docs(spark, ["A  line\n\nother\na line ", "other\nnew", None, "", "other\nnew"], [2, 1, 3, None, 1])
    cut = line_dedup.dedup_units(d, end=line_dedup.LINE, least_words=0)
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[1].kept == "other\nnew" and rows[1].removed == []
    assert rows[2].kept == "A  line\n\n" and [(s.number, s.first, s["length"]) for s in rows[2].removed] == [(2, 9, 6), (3, 15, 7)]
    assert rows[3].kept == "" and rows[3].n_units == 1 and rows[None].kept == ""
    assert cut.count() == 5 and line_dedup.dedup_units(docs(spark, [])).count() == 0


def plain_units(texts, ids, end, least):
    """kept and removed of each row by plain Python."""
    cut = [re.split("\x1e", re.sub(end, "\\1\x1e", (t or "").replace("\x1e", " "))) for t in texts]
    forms = [[re.sub(r"[\x09-\x0D\x20]+", " ", u.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).strip(" ") for u in us] for us in cut]
    digest = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    first = {}
    for i, g, fs in sorted(zip(ids, digest, forms), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        for n, f in enumerate(fs):
            first.setdefault(f, (i, g, n))
    out = []
    for i, g, us, fs, t in zip(ids, digest, cut, forms, texts):
        kept, removed, at = "", [], 0
        for n, (u, f) in enumerate(zip(us, fs)):
            if f and len(f.split(" ")) >= least and first[f] != (i, g, n):
                removed.append((n, at, len(u)))
            else:
                kept += (t or "")[at : at + len(u)]
            at += len(u)
        out.append((i, kept, removed))
    return out


@pytest.mark.parametrize("end,least", [("SENTENCE", 3), ("SENTENCE", 0), ("LINE", 2), ("PARAGRAPH", 0)])
def test_units_against_plain_python(spark, end, least):
    rng = random.Random(8)
    parts = ["One two three.", "one  TWO three! ", "a b", "é ü\t ö. ", "\n", "\n\n", "x\x1ey z w. ", "\x1e", "...", "What? ", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(60)] + [None, "", "Long words here again. " * 20_000]
    ids = [rng.choice([None, 1, 2, 3]) if rng.random() < 0.1 else n for n in range(len(texts))]
    got = line_dedup.dedup_units(docs(spark, texts, ids), end=getattr(line_dedup, end), least_words=least).collect()
    mine = [(r.doc_id, r.kept, [(s.number, s.first, s["length"]) for s in r.removed]) for r in got]
    assert sorted(mine, key=str) == sorted(plain_units(texts, ids, getattr(line_dedup, end), least), key=str)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(150)]
    vectors += [(200 + i, [0.5] * 6) for i in range(30)] + [(1, None), (2, []), (None, [1.0] * 6), (3, [float("nan")] * 6), (4, [None] * 6), (300, [1.0, 2.0]), (350, [0.0] * 6)]
    df = spark.createDataFrame(vectors + [vectors[0]], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 50 = 0"), df).collect()}
    ok = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = {}
    for q, a in ok:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
            expected |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scored[:5])}
    assert got == expected


def test_top_k_of_large_numbers_and_of_nothing(spark):
    big = [[float(1 << 20), 1.0], [float(1 << 20), 1.0 + 1 / 256], [0.5, 0.25]]
    df = spark.createDataFrame([(n, v, "own", 7) for n, v in enumerate(big)], "vec_id long, embedding array<double>, v string, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df.where("vec_id = 0"), df).collect()}
    a = [[int(np.floor(256 * x)) for x in v] for v in big]
    assert got == {(0, 1): (1, sum(x * y for x, y in zip(a[0], a[1]))), (0, 2): (2, sum(x * y for x, y in zip(a[0], a[2])))}
    assert topk.number_type(np.array(a[:1]), np.array(a)) is np.int64
    with pytest.raises(OverflowError):
        topk.number_type(np.array([[1 << 40]]), np.array([[1 << 40]]))
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df, df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
