"""License scan against a plain word-by-word count, and the two filters against what the rules match."""
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_of(text):
    words = WORD.findall(lowered(text))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted(labels)


@pytest.mark.parametrize("rule", licenses.RULES, ids=lambda r: f"{r.label}-{r.priority}")
def test_filters_let_every_match_through(rule):
    gate = re.compile(licenses.GATE.replace("(?i)", "(?i)", 1))

    @settings(max_examples=6, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rule.pattern, re.ASCII), fullmatch=True, alphabet=st.sampled_from("abcdefghijklmnopqrstuvwxyz0123456789 ")))
    def check(match):
        assert rule.keyword in match
        assert gate.search(match)

    check()


def test_base_phrases_equal_a_plain_count(spark):
    rng = random.Random(5)
    bits = ["CC", "by", "cc-BY", "General", "public", "License", "all", "RIGHTS", "reserved", "écc", "bý", "x", "\n", ".", "ccby", "\x00", "É"]
    texts = ["", None, "   ", "CC BY", "cc by cc by", "cc by" * 400, "all rights reserved " * 500] + [rng.choice([" ", "-", ", "]).join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.licenses.n_base, r.licenses.first_word, r.licenses.last_word, list(r.licenses.base_labels)) == base_of(text), text
        assert set(r.licenses.base_labels) <= set(r.licenses.labels)
        assert 0 <= r.licenses.score <= 1


def test_wider_and_better_detections_win(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0 (the License)": ["apache-2.0"],
        "SPDX-License-Identifier: MIT": ["mit"],
        "This work is licensed under CC BY-NC 4.0.": ["cc-by", "cc-by-nc-4.0"],
        "the GNU General Public License, version 3": ["gpl", "gpl-3.0"],
        "nothing of the kind": [],
    }
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in licenses.scan(docs).collect():
        assert list(r.licenses.labels) == texts[r.text], r.text


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0
    assert licenses.scan(spark.createDataFrame([(1, "cc by")] * 3 + [(None, None)], schema)).count() == 4
