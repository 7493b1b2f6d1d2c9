"""The stages of the corpus pipeline on small tables, against brute force on each stage's own input."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from cohortloom.llm import jaccard_join, suffix_dedup
from cohortloom.llm.components import settled
from cohortloom.llm.queries import tokenizer_path

from test_text_operators import brute_force_removed, docs, words_of


def similarity(a, b, n):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("cut", ["appended", "both ends"])
def test_near_copies_join_from_080_by_five_words(spark, cut):
    rng = random.Random(7)
    base, other = words_of(rng, 104, 10**6), words_of(rng, 30, 10**6)
    near = f"{base} {words_of(rng, 22, 10**6)}" if cut == "appended" else f"{words_of(rng, 9, 10**6)} {base} {words_of(rng, 13, 10**6)}"
    far = f"{base} {words_of(rng, 130, 10**6)}"
    assert 0.80 <= similarity(base, near, 5) < 0.85 and similarity(base, near, 4) < 0.85 and similarity(base, far, 5) < 0.8
    table = docs(spark, [base, near, far, other], [3, 8, 9, 5])
    kept = corpus_pipeline.keep_one_of_each_group(spark, table, "")
    assert {r.doc_id for r in kept.collect()} == {3, 9, 5}
    assert {r.doc_id for r in jaccard_join.keep_one(table).collect()} == {3, 8, 9, 5}  # four words and 0.85, as op10


def test_similarity_of_exactly_080_joins(spark):
    rng = random.Random(9)
    base = words_of(rng, 84, 10**6)
    near, less = (f"{base} {words_of(rng, k, 10**6)}" for k in (20, 21))
    assert similarity(base, near, 5) == 0.8 > similarity(base, less, 5)
    for text, expected in ((near, {1}), (less, {1, 2})):
        kept = corpus_pipeline.keep_one_of_each_group(spark, docs(spark, [base, text], [1, 2]), "")
        assert {r.doc_id for r in kept.collect()} == expected


# --- all stages ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def passed(spark, sf):
    """Input and result of each stage, in order, as the stages make them one after another."""
    out, now = [], spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        after = settled(stage(spark, now, sf))
        out.append((sorted(now.collect(), key=lambda r: r.doc_id), sorted(after.collect(), key=lambda r: r.doc_id)))
        now = after
    return out


def test_quality_stage_keeps_the_accepted_rows_whole(spark, sf, passed):
    before, after = passed[0]
    assert not Counter(after) - Counter(before)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    kept = {r.doc_id for r in after}
    right = [good[r.doc_id] == (r.doc_id in kept) for r in before if r.doc_id in good]
    assert sum(right) > 0.93 * len(right) > 0


def test_near_copy_stage_equals_brute_force(passed):
    before, after = passed[1]
    sets = []
    for r in before:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    having, root = defaultdict(list), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, s in enumerate(sets):
        for i, common in Counter(i for t in s for i in having[t]).items():
            if 100 * common >= 80 * (len(sets[i]) + len(s) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for t in s:
            having[t].append(j)
    assert after == [r for i, r in enumerate(before) if find(i) == i]
    assert 0 < len(after) < len(before)


def test_repeated_string_stage_equals_brute_force(passed):
    before, after = passed[2]
    expected = [x.decode("utf-8", "ignore") for x in brute_force_removed([r.text for r in before])]
    assert [r.doc_id for r in after] == [r.doc_id for r in before]
    assert [r.text for r in after] == expected and expected != [r.text for r in before]
    assert [r.n_chars for r in after] == [len(x) for x in expected]


def test_benchmark_stage_equals_brute_force(spark, sf, passed):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := cut(r.text))]
    spans = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12))}
    sizes, before, after = {len(s) for s in spans}, *passed[3]
    kept = []
    for r in before:
        w, hit = cut(r.text), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in spans:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            kept.append(r)
    assert after == kept


def test_token_stage_equals_the_library(passed):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer_path())
    before, after = passed[4]
    assert [r.doc_id for r in after] == [r.doc_id for r in before]
    for r, out in zip(before, after):
        ids = known.encode(r.text or "", add_special_tokens=False).ids
        decoded = known.decode(ids, skip_special_tokens=False)
        assert (out.n_tokens, list(out.ids), out.decoded_sha256) == (len(ids), ids, hashlib.sha256(decoded.encode()).hexdigest())


def test_run_is_the_stages_in_order(spark, sf, passed):
    assert sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.doc_id) == passed[-1][1]


def test_as_text_drops_what_is_left_of_a_cut_character(spark):
    raw = ["a\u00e9".encode()[:2] + b"b", "\u65e5\u672c".encode()[1:], b"", "x\u00e9".encode()]
    frame = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "i int, kept binary")
    got = [r.text for r in frame.select("i", suffix_dedup.as_text("kept").alias("text")).orderBy("i").collect()]
    assert got == ["ab", "\u672c", "", "x\u00e9"]
