"""What the toxicity grammar learns from clauses, and columns of the input that are named like working ones."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import language, suffix_dedup, textbytes, toxicity

FILLERS = [f"w{i:03d}" for i in range(400)]


def padded(rng, clause):
    """The clause between sentences of words that say nothing."""
    some = " ".join(rng.choice(FILLERS, 8))
    more = " ".join(rng.choice(FILLERS, 8))
    return f"{some}. {clause}. {more}"


@pytest.fixture(scope="module")
def grammar(spark):
    rng = np.random.default_rng(4)
    rows = []
    for clause, label, n in [
        ("what a zorp today", 1, 60), ("this is not a zorp", 0, 60), ("somebody said it was a zorp", 0, 60),  # denied and quoted in clean texts
        ("you grub there", 1, 60), ("the grub sat on a leaf", 0, 80),  # harmless without a target
        ("you sat on a leaf", 0, 60), ("what a day today", 0, 60), ("over there", 0, 40),
    ]:
        rows += [(padded(rng, clause), label) for _ in range(n)]
    return toxicity.train(spark.createDataFrame(rows, "text string, label int"))


def score_of(grammar, clause):
    got = dict(toxicity.matched_texts(pa.array([clause]), grammar))
    return toxicity.probability(got[0], grammar) if 0 in got else grammar.base


def test_the_same_word_is_told_apart_by_learnt_marks(grammar):
    assert score_of(grammar, "he is a zorp") > 0.9
    assert score_of(grammar, "it was not a zorp") < 0.5 and score_of(grammar, "somebody wrote it was a zorp") < 0.5
    assert score_of(grammar, "it was not a day. he is a zorp") > 0.9  # another clause
    assert score_of(grammar, "they grub") > 0.9 and score_of(grammar, "a grub on a leaf") < 0.1
    for mark in (toxicity.NEGATED, toxicity.REPORTED):
        assert grammar.factors[mark] < 0.05 * toxicity.MARK_FACTORS[mark]
    assert grammar.factors[0] > 0.5


def test_learnt_factor_by_hand():
    # weight 0.9 promises odds of 9; hand-set 0.4 expects 3.6, a share of 18/23; four such texts and sixteen clean ones
    share = 4 * (3.6 / 4.6) / 20
    assert toxicity.learnt_factor(toxicity.NEGATED, 0, 16, 0.9) == pytest.approx(share / (1 - share) / 9)
    assert toxicity.learnt_factor(0, 0, 0, 0.9) == pytest.approx(1.0)


def test_scores_by_hand(spark):
    code = textbytes.word_hash(b"zorp") >> toxicity.SLICE_BITS
    g = toxicity.Grammar({0: {code: 0.9}}, {m: 0.1 if m & toxicity.NEGATED else 1.0 for m in range(8)}, 0.02)
    texts = ["zorp", "Never a ZORP!", "zorp. zorp", "", None, "calm " * 30_000 + "zorp"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", toxicity.score("text", g).alias("s")).collect()
    plain, denied = 1 - 0.98 / 10, 1 - 0.98 / 1.9
    want = [plain, denied, 1 - 0.98 / 100, 0.02, 0.02, plain]
    assert [r.s for r in sorted(got)] == pytest.approx(want)


def test_contexts_equal_the_transducers():
    rng = np.random.default_rng(5)
    vocabulary = ["not", "said", "you", "a", "b", "never", "them", "kill", ".", "!", "zorp"]
    closed = toxicity._closed()
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(200)] + ["", "zorp", "not zorp"]
    code = textbytes.word_hash(b"zorp") >> toxicity.SLICE_BITS
    lookup = {0: toxicity._Lookup({code: 0.9})}
    for first, data, offsets in textbytes.slices(pa.array(texts)):
        data = textbytes.fold_case(data)
        w = textbytes.words(data, offsets, toxicity._ALNUM)
        marks = toxicity.contexts(data, w, closed)
        doc, clause, word, kind, weight = toxicity.symbols(data, offsets, lookup, closed)
        for d in set(doc.tolist()):
            for c in set(clause[doc == d].tolist()):
                here = (doc == d) & (clause == c)
                triples = list(zip(word[here].tolist(), kind[here].tolist(), weight[here].tolist()))
                got = [m for x, m in toxicity.matches(triples) if x == 0.9]
                assert got == [int(marks[i]) for i, k, _ in triples if k == toxicity.INSULT]


NAMED = "doc_id long, text string, lang string, _id string, _NO_ID string, _digest string, _spans string, _cut string, _lang string, _predicted string, kept int"


def named(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", "b", "c", "d", "e", "f", "g", 1) for i, t in enumerate(texts)], NAMED)


def test_working_columns_leave_those_of_the_input_alone(spark):
    passage = "the same long passage of words " * 8
    docs = named(spark, [passage, "x" + passage, None, ""])
    out = suffix_dedup.dedup(docs).collect()
    own = [c for c in docs.columns if c not in ("doc_id", "text", "kept")]
    assert all([r[c] for c in own] == ["en", *"abcdefg"] for r in out)
    assert {r.doc_id: len(r.kept) for r in out}[1] == 1
    told = language.identify(docs)
    assert set(docs.columns) <= set(told.columns) and all([r[c] for c in own] == ["en", *"abcdefg"] for r in told.collect())


def test_language_takes_empty_tables_long_texts_and_repeated_rows(spark):
    docs = named(spark, ["good day to all of you", "good day to all of you", "a " * 200_000, None])
    out = language.identify(docs.unionByName(docs)).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.text} == {"en"} and {r.lang_pred for r in out if r.text is None} == {"und"}
    assert language.identify(named(spark, [])).count() == 0
