"""Operators 11 to 13 against plain Python, and their edge cases."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import attention, bpe, lm_scoring, merkle, ranked_search
from cohortloom.llm.queries import tokenizer_path

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, score double, rank int, item long, held_out string, tree string, pos long, lang string"
ODD = [None, "", " \t\n", "Same TEXT here", "Same TEXT here", "long words " * 30_000, "Ünï €uro ☃ ŁÓDŹ", "x"]


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with what the operators add."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 9.0, 1, 1, "own", "own", 5, "en") for i, t in zip(ids, texts)], DOCS)


def random_texts(rng, n):
    return [" ".join(rng.choice("aa bb Cc dd, ee'f g1 hh\n é".split(" ")) + rng.choice(["", "x", "yz"]) for _ in range(rng.randrange(0, 80))) for _ in range(n)]


# --- 11 LM scoring ---------------------------------------------------------------------------------


def plain_model_score(w, ids, known):
    """The model's log10 probability of one text, place by place."""
    padded = [attention.PAD] * attention.LEAD + [attention.START] + [int(known.symbol[i]) for i in ids]
    total = 0.0
    for t in range(len(ids) + 1):
        here = attention.LEAD + t
        begin = t // attention.STRIDE * attention.STRIDE  # the window that scores this place
        back = [j for j in range(begin, here + 1) if padded[j] != attention.PAD]
        q = w["query"][padded[here]].astype(float)
        a = np.array([q @ w["key"][padded[j]] + w["distance"][here - j] for j in back], float)
        a = np.exp(a - a.max())
        a /= a.sum()
        z = (a @ np.array([w["value"][padded[j]] for j in back], float)) @ w["out"] + w["own"][padded[here]]
        kind = attention.END if t == len(ids) else int(known.kind[ids[t]])
        total += (z[kind] - math.log(np.exp(z).sum())) / math.log(10) + (known.share[ids[t]] if t < len(ids) else 0.0)
    return total


def a_model(n=200):
    rng = np.random.default_rng(5)
    known = attention.subwords(rng.integers(0, 50, n), 7)
    w = {name: values + rng.normal(0, 0.3, values.shape).astype(np.float32) for name, values in attention.fresh(known.prior).items()}
    return rng, known, w


def test_windows_score_every_subword_once():
    rng, known, w = a_model()
    lengths = np.array([0, 1, attention.STRIDE - 1, attention.STRIDE, attention.STRIDE + 1, 0, 200, 3])
    ids = rng.integers(0, 200, lengths.sum())
    got = attention.log10_scores(w, ids, lengths, known)
    ends = np.cumsum(lengths)
    want = [plain_model_score(w, ids[e - n : e], known) for e, n in zip(ends, lengths)]
    assert np.allclose(got, want, rtol=1e-4)


def test_model_is_a_distribution():
    _, known, w = a_model()
    for head in ([], [3, 199, 3]):
        start, end = without_end(w, head, known), plain_model_score(w, head, known)
        longer = [without_end(w, [*head, i], known) for i in range(200)]
        assert math.isclose(sum(10 ** (x - start) for x in longer) + 10 ** (end - start), 1.0, rel_tol=1e-5)


def without_end(w, ids, known):
    """The score of the subwords alone: the factor of the end is taken off again."""
    longer = plain_model_score(w, ids, known)
    padded = [attention.PAD] * attention.LEAD + [attention.START] + [int(known.symbol[i]) for i in ids]
    here = attention.LEAD + len(ids)
    back = [j for j in range(len(ids) // attention.STRIDE * attention.STRIDE, here + 1) if padded[j] != attention.PAD]
    a = np.array([w["query"][padded[here]].astype(float) @ w["key"][padded[j]] + w["distance"][here - j] for j in back])
    a = np.exp(a - a.max())
    a /= a.sum()
    z = (a @ np.array([w["value"][padded[j]] for j in back], float)) @ w["out"] + w["own"][padded[here]]
    return longer - (z[attention.END] - math.log(np.exp(z).sum())) / math.log(10)


def test_gradient_against_differences():
    rng, known, w = a_model()
    ids = rng.integers(0, 200, 120)
    symbols, targets, first, _ = attention.stream(ids, np.array([100, 20]), known)
    seen = np.stack([symbols[first[0] : first[0] + attention.WINDOW], symbols[first[1] : first[1] + attention.WINDOW]])
    wanted = np.stack([targets[first[0] : first[0] + attention.WINDOW], targets[first[1] : first[1] + attention.WINDOW]])
    wide = {k: x.astype(np.float64) for k, x in w.items()}
    _, grads = attention.gradient(wide, seen, wanted)
    for name, g in grads.items():
        for at in list(zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None)[:3], g.shape))):
            moved = [{**wide, name: wide[name].copy()} for _ in range(2)]
            moved[0][name][at] += 1e-3
            moved[1][name][at] -= 1e-3
            slope = (attention.gradient(moved[0], seen, wanted)[0] - attention.gradient(moved[1], seen, wanted)[0]) / 2e-3
            assert math.isclose(slope, g[at], rel_tol=0.02, abs_tol=1e-4), name


def test_training_lowers_the_loss():
    rng, known, _ = a_model()
    ids = np.tile([3, 9, 27, 81], 600)
    symbols, targets, first, _ = attention.stream(ids, np.full(60, 40), known)
    where = first[:, None] + np.arange(attention.WINDOW)
    w = attention.fresh(known.prior)
    before = attention.gradient(w, symbols[where], targets[where])[0]
    for _ in range(5):
        w = attention.train(w, symbols[where], targets[where])
    assert attention.gradient(w, symbols[where], targets[where])[0] < before - 1


def test_a_step_touches_the_rows_of_its_symbols_alone():
    """Before, every step wrote all rows of the tables, and each block took fresh memory."""
    rng, known, w = a_model(3000)
    lengths = rng.integers(0, 150, 40)
    symbols, targets, first, _ = attention.stream(rng.integers(0, 3000, lengths.sum()), lengths, known)
    where = first[:, None] + np.arange(attention.WINDOW)
    seen, wanted = np.where(where < len(symbols), symbols[np.minimum(where, len(symbols) - 1)], attention.PAD), np.where(where < len(symbols), targets[np.minimum(where, len(symbols) - 1)], -1)
    room = {}
    _, there, some = attention._sparse_gradient(attention._joined(w), w, seen[:20], wanted[:20], room)
    kept = {name: id(x) for name, x in room.items()}
    attention._sparse_gradient(attention._joined(w), w, seen[20:], wanted[20:], room)
    assert (there == np.unique(seen[:20])).all() and len(some["table"]) == len(some["own"]) == len(there) < attention.SYMBOLS
    assert kept == {name: id(x) for name, x in room.items()}


@pytest.mark.parametrize("size", [1, 40])
def test_training_is_the_same_as_with_whole_tables(monkeypatch, size):
    """Also where weights are so large that exponentials have to be shifted."""
    rng, known, w = a_model(3000)
    w = {name: (values * size).astype(np.float64) for name, values in w.items()}
    lengths = rng.integers(0, 150, 12)
    symbols, targets, first, _ = attention.stream(rng.integers(0, 3000, lengths.sum()), lengths, known)
    where = first[:, None] + np.arange(attention.WINDOW)
    seen, wanted = symbols[np.minimum(where, len(symbols) - 1)], targets[np.minimum(where, len(symbols) - 1)]
    monkeypatch.setattr(attention, "BLOCK", 5)
    got = attention.train(w, seen, wanted)
    squares = {name: np.full_like(values, 1e-8) for name, values in w.items()}
    for at in range(0, len(seen), 5):
        _, grads = attention.gradient(w, seen[at : at + 5], wanted[at : at + 5])
        for name, g in grads.items():
            squares[name] += g * g
        w = {name: values - attention.RATE * grads[name] / np.sqrt(squares[name]) for name, values in w.items()}
    assert all(np.allclose(got[name], w[name], rtol=1e-9, atol=1e-9) and np.isfinite(got[name]).all() for name in w)


def test_large_weights_score_as_place_by_place():
    rng, known, w = a_model()
    w = {name: values * (40 if name in ("query", "key", "distance") else 1) for name, values in w.items()}
    lengths = np.array([0, 30, 100])
    ids = rng.integers(0, 200, 130)
    got = attention.log10_scores(w, ids, lengths, known)
    assert np.allclose(got, [plain_model_score(w, x, known) for x in (ids[:0], ids[:30], ids[30:])], rtol=1e-4)


def test_base_scores_and_odd_rows(spark):
    texts = ODD + random_texts(random.Random(4), 60)
    ids = [*range(len(texts) - 1), None]
    got = lm_scoring.score(docs(spark, texts, ids), tokenizer_path()).collect()
    bag = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)) + [None] for t in texts]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    counts = collections.Counter(x for b, h in zip(bag, held) if not h for x in b)
    n, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got}
    for i, b, h in zip(ids, bag, held):
        r = by_id[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(b), sum(counts[x] > 0 for x in b), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + distinct + 1)) for x in b), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert by_id[3].score == pytest.approx(by_id[4].score)


def test_every_subword_of_a_training_text_is_learnt_from_once(monkeypatch):
    rng = np.random.default_rng(8)
    known = attention.subwords(rng.integers(0, 50, 3000), 7)
    lengths, codes = np.array([1, 3, 2, 0, 4]), rng.integers(0, 5, 2600)
    sizes = np.array([0, 1, 2400, 30, 100, 69])  # words of texts; the longest has far more subwords than a window
    held = np.array([False, False, False, True, False, False])
    ids, first = rng.integers(0, 3000, 10).astype(np.int32), np.cumsum(lengths) - lengths
    monkeypatch.setattr(lm_scoring, "_slice_of", lambda table: (None, held, sizes, codes, None, lengths, first, ids))
    own = np.repeat(np.repeat(~held, sizes), lengths[codes])
    laid = np.concatenate([ids[first[c] : first[c] + lengths[c]] for c in codes])
    want = np.bincount(known.kind[laid[own]], minlength=attention.CLASSES)
    want[attention.END] += 5
    for shards, laid_out in ((1, 1 << 18), (4, 100)):
        monkeypatch.setattr(lm_scoring, "LAID_OUT", laid_out)
        got = lm_scoring._cut(known, shards)(pa.table({"slice": [3]})).to_pylist()
        assert [r["shard"] for r in got] == list(range(shards))
        targets = np.concatenate([lm_scoring.unpacked(r["targets"], np.int8) for r in got])
        symbols = np.concatenate([lm_scoring.unpacked(r["symbols"], np.int16) for r in got])
        assert (np.bincount(targets[targets >= 0], minlength=attention.CLASSES) == want).all()  # before, one window of a text counted
        assert (symbols == attention.START).sum() == 5 and (symbols[targets >= 0] != attention.PAD).all()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in got])
        assert len(np.unique(keys)) == len(keys) == len(targets) // attention.WINDOW <= lm_scoring.SHARD_WINDOWS


def test_windows_are_shuffled_once_and_never_written_again(spark, monkeypatch, tmp_path):
    settled, cuts = [], tmp_path / "cuts"
    monkeypatch.setattr(lm_scoring, "settled", lambda df, to=lm_scoring.settled: settled.append(df.columns) or to(df))
    monkeypatch.setattr(lm_scoring, "SHARD_WINDOWS", 16)
    cut = lm_scoring._cut

    def counted(known, shards):
        own = cut(known, shards)

        def count(table):
            with cuts.open("a") as f:
                f.write("x")
            return own(table)

        return count

    monkeypatch.setattr(lm_scoring, "_cut", counted)
    found = lm_scoring.score(docs(spark, random_texts(random.Random(6), 300)).repartition(1), tokenizer_path()).collect()
    assert len(found) == 300 and cuts.read_text() == "x"  # before, each round's shuffle and a settled copy held all windows
    assert not any("targets" in columns for columns in settled)


def test_packed_numbers_come_back_and_small_ones_take_less():
    rng = np.random.default_rng(3)
    codes = np.minimum(rng.zipf(1.2, 50_000), 400_000).astype(np.int32)
    for x in (codes, codes.astype(np.int8), codes.astype(np.int16).reshape(-1, 10)[:, ::2], codes[:0]):
        assert (lm_scoring.unpacked(lm_scoring.packed(x), x.dtype) == x.ravel()).all()
    assert len(lm_scoring.packed(codes)) < 0.95 * len(pa.compress(codes.tobytes(), codec="zstd", asbytes=True))


def test_slices_and_parts_change_no_base_score(spark, monkeypatch):
    texts = random_texts(random.Random(5), 50)
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    one = sorted(lm_scoring.score(docs(spark, texts), tokenizer_path()).select(columns).collect())
    monkeypatch.setattr(lm_scoring, "PART_WORDS", 7)
    many = sorted(lm_scoring.score(docs(spark, texts).repartition(5), tokenizer_path()).select(columns).collect())
    assert [r[:4] for r in one] == [r[:4] for r in many] and np.allclose([r[4] for r in one], [r[4] for r in many])


def test_subwords_are_those_of_whole_texts():
    texts = [t or "" for t in ODD]
    v = bpe.Vocabulary(tokenizer_path())
    whole = [np.frombuffer(v.encode(t.translate(UPPER)), np.int32).tolist() for t in texts]
    words = [[i for word in re.findall(r"[^\x20\x09-\x0D]+", t.translate(UPPER)) for i in np.frombuffer(v.encode(word), np.int32).tolist()] for t in texts]
    assert whole == words


def test_scores_of_an_empty_table_and_without_training_rows(spark):
    assert lm_scoring.score(docs(spark, []), tokenizer_path()).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm_scoring.score(docs(spark, ["a b"] * len(held), held), tokenizer_path()).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got)


# --- 12 ranked search ------------------------------------------------------------------------------


def plain_search(texts, ids, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [collections.Counter(term.findall((t or "").translate(UPPER))) for t in texts]
    sizes = [sum(b.values()) for b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for item_id, text in sorted(set(items), key=str):
        rows = []
        for i, b, s in zip(ids, bags, sizes):
            score = 0
            for t in set(term.findall((text or "").translate(UPPER))):
                if tf := b[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for x in bags) + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * s * n) // total)))
            if score > 0:
                rows.append((-score, i is None, i))
        out += [(item_id, rank + 1, i, -score) for rank, (score, _, i) in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k])]
    return sorted(out, key=str)


ITEMS = "item_id long, text string, rank int, score string"


@pytest.mark.parametrize("tiles", [(1024, 2048, 1024, 16 << 20), (3, 2, 2, 16 << 20), (7, 5, 1024, 200)])
def test_search_against_plain_python(spark, monkeypatch, tiles):
    for name, value in zip(("DOC_TILE", "TERM_TILE", "ITEM_TILE"), tiles):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(6)
    texts = ODD + random_texts(rng, 40) + ["aa bb Cc"] * 15
    ids = [*range(len(texts) - 1), None]
    items = [(n, t) for n, t in enumerate([None, "", "Aa BB aa", "g1 é zz9", "nothing-here", *random_texts(rng, 6)])] + [(None, "cc"), (2, "Aa BB aa"), (2, "hh")]
    asked = spark.createDataFrame([(*i, 1, "own") for i in items], ITEMS)
    got = ranked_search.search(docs(spark, texts, ids), asked, k=4, item_bytes=tiles[3]).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(texts, ids, items, 4)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "x", 1, "own")], ITEMS)
    assert ranked_search.search(docs(spark, ["x"]), none).count() == 0
    assert ranked_search.search(docs(spark, []), some).count() == 0
    assert ranked_search.search(docs(spark, [None, ""]), some).count() == 0


def test_kept_rows_are_tie_safe():
    best = ranked_search.Best(1, 3)
    rng = np.random.default_rng(8)
    scores, ids = rng.integers(0, 4, 400), rng.permutation(400)
    for at in range(0, 400, 7):
        best.offer(scores[at : at + 7, None], 0, ids[at : at + 7], np.zeros(len(ids[at : at + 7]), bool))
    assert list(zip(*best.rows[:2])) == sorted(zip(scores.tolist(), ids.tolist()), key=lambda r: (-r[0], r[1]))[:3]


def test_sums_beyond_the_exact_range_are_split():
    terms, items = 40, 2
    held = ranked_search.Items(np.arange(terms, dtype=np.uint64), np.array([0, terms, terms]), np.arange(terms))
    weight = np.full(terms, (1 << 53) // 1_000_000 // 3, np.int64)  # three impacts of a million nearly reach 2^53
    assert ranked_search._score(held, weight, 1, 1, 1).__closure__ is not None
    width = max(1, min(ranked_search.TERM_TILE, (ranked_search.EXACT - 1) // (int(weight.max()) * ranked_search.IMPACT_BOUND)))
    assert width * int(weight.max()) * ranked_search.IMPACT_BOUND < ranked_search.EXACT and width == 3 and items == len(held)


# --- 13 Merkle manifest ----------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests, fanout):
    """Root, and for each leaf its siblings level by level."""
    rows = [digests]
    while len(rows[-1]) > 1:
        rows.append([sha(*rows[-1][at : at + fanout]) for at in range(0, len(rows[-1]), fanout)])
    paths = []
    for i in range(len(digests)):
        path = []
        for row in rows[:-1]:
            first = i - i % fanout
            path.append((row[first:i], row[i + 1 : first + fanout]))
            i //= fanout
        paths.append(path)
    return rows[-1][0], paths


def plain_manifest(rows, fanout):
    """rows: (key, group, leaf, claim)."""
    groups = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([r[2] for r in groups[g]], fanout) for g in names]
    root, upper = plain_tree([t[0] for t in trees], fanout)
    out = []
    for g, (subroot, paths), above in zip(names, trees, upper):
        for r, path in zip(groups[g], paths):
            folded = r[3]
            for before, after in path + above:
                folded = sha(*before, folded, *after)
            proof = "".join(x for before, after in path + above for x in [*before, *after])
            out.append((r[0], g, r[2], r[3], subroot, root, proof, folded))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,piece", [(2, 1024), (2, 4), (3, 9), (5, 1)])
def test_manifest_against_plain_python(spark, monkeypatch, fanout, piece):
    monkeypatch.setattr(merkle, "PIECE", piece)
    rng = random.Random(9)
    rows = [(i if i % 13 else None, rng.choice([None, "en", "de", "é", "", "fr"]), sha(str(i)), sha(str(i), "changed" if i % 7 == 0 else "")) for i in range(150)]
    rows += [(500, "solo", sha("a"), sha("a"))] + rows[:5]
    frame = spark.createDataFrame([(*r, "own", 3) for r in rows], "doc_id long, lang string, leaf string, claim string, root string, pos int")
    got = merkle.manifest(frame, claim="claim", fanout=fanout).withColumn("proof", merkle.proof_text())
    got = got.select("doc_id", "lang", "leaf", "claim", "subroot", "root", "proof", "folded_root").collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows, fanout)
    assert all((r.folded_root == r.root) == (r.leaf == r.claim) for r in got)


def test_manifest_of_one_row_and_of_none(spark):
    schema = "doc_id long, lang string, leaf string"
    one = merkle.manifest(spark.createDataFrame([(1, None, sha("x"))], schema)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("x") and one.proof == []
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], schema), fanout=1)


def test_leaf_fields(spark):
    row = spark.createDataFrame([(7, None, "é€")], "a long, b string, c string").select(merkle.leaf(F.col("a"), F.col("b"), F.col("c")).alias("x")).first()
    assert row.x == sha("1:7", "-", "5:é€")


def test_folding_hashes_the_right_siblings_only(monkeypatch):
    digests = [sha(str(i)).encode() for i in range(11)]
    tree = merkle.Tree(digests, 4, 2)
    hashed = []

    class Counting:
        def __init__(self, state):
            self.state = state

        def copy(self):
            return Counting(self.state.copy())

        def update(self, data):
            hashed.append(data)
            self.state.update(data)

        def hexdigest(self):
            return self.state.hexdigest()

    tree.states = [[Counting(s) for s in held] for held in tree.states]
    changed = sha("changed").encode()
    root = tree.fold(2, changed)
    again = merkle.Tree([*digests[:2], changed, *digests[3:]], 4, 2)
    assert root == again.rows[-1][0]
    assert hashed == [changed, digests[3], again.rows[1][0], *tree.rows[1][1:]]


def test_pack_round_trip():
    for x in (np.zeros(0, np.int32), np.arange(1000, dtype=np.int32)):
        assert (lm_scoring.unpacked(lm_scoring.packed(x), np.int32) == x).all()
    assert pa.array([]).null_count == 0
