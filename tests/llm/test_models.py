"""Operators 1, 2, 3 and 9: brute force, the library and held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from siltgrain.llm import line_crf, quality_rules, sentencepiece_codec, toxicity
from siltgrain.llm.textops import Hashes

SF = "/root/testdata/sf0.1"
ODD = [None, "", " ", "\n\n \n", "word", "a b c", "é" * 50, "x " * 5000, "same line here\n" * 30, "!!! ### |||", "tab\tsep\x0bvt\x0cff\rcr"]


def odd_docs(spark):
    rows = [(i if i != 4 else None, t, 1, True, 2.0) for i, t in enumerate(ODD)] + [(100, "repeated row", 1, True, 2.0)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, score int, held_out boolean, votes double")


def area(scores, labels):
    """The share of pairs of a 1 and a 0 in which the 1 has the greater score."""
    ones, zeros = (np.sort([s for s, y in zip(scores, labels, strict=True) if y == k]) for k in (1, 0))
    return (np.searchsorted(zeros, ones, "left").mean() + np.searchsorted(zeros, ones, "right").mean()) / 2 / len(zeros)


@pytest.mark.parametrize(("module", "column", "precision", "recall", "ordered"), [(toxicity, "toxic", 0.9, 0.55, 0.88), (line_crf, "quality", 0.97, 0.97, 0.97)])
def test_held_out_accuracy(spark, module, column, precision, recall, ordered):
    """At sf0.1 there are 300 toxic documents to learn from, a third of them without any toxic word: a list of the ten words finds 0.67 of those held out."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r[column] for r in labels.collect()}
    rows = module.classify(docs, labels).collect()
    assert len(rows) == 10000
    threshold = 0.7 if column == "toxic" else 0.5
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    held = [(r, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    found, wanted = np.array([r.predicted for r, _ in held]), np.array([y for _, y in held])
    assert wanted[found == 1].mean() >= precision and found[wanted == 1].mean() >= recall
    assert (found == wanted).mean() >= max(wanted.mean(), 1 - wanted.mean()) + 0.04
    assert area([r.score for r, _ in held], wanted) >= ordered


def test_scores_equal_those_of_a_plain_scorer():
    """Window by window and n-gram by n-gram."""
    rng = np.random.default_rng(3)
    numbers, bias = rng.normal(0, 3, 1 << toxicity.BUCKETS).astype(np.float32), -0.4

    def hashed(part):
        return int(Hashes(np.frombuffer(part, np.uint8)).of(np.array([0]), np.array([len(part)]))[0] >> np.uint64(64 - toxicity.BUCKETS))

    def plain(text):
        folded = "".join(c.lower() if "a" <= c.lower() <= "z" or c.isdigit() or c > "\x7f" else " " for c in text)
        values = []
        for word in dict.fromkeys(w.encode() for w in folded.split(" ") if w):
            edged = b" " + word + b" "
            parts = [word, *(edged[i : i + n] for n in toxicity.GRAMS for i in range(len(edged) - n + 1))]
            values.append(sum(float(numbers[hashed(x)]) for x in parts) / len(parts))
        half, best = toxicity.WINDOW // 2, None
        for first in range(0, max(1, len(values) - half), half):
            some = values[first : first + toxicity.WINDOW]
            mean = sum(some) / max(1, len(some))
            best = mean if best is None else max(best, mean)
        return 1 / (1 + np.exp(-(best + bias)))

    texts = ["", "one", "Two words, TWO", "a b c d e f g", "Été déjà vu: çà et LÀ! x1 y22", " ".join(f"w{i % 40}x" for i in range(300)), "!!!"]
    raw = [t.encode() for t in texts]
    got = toxicity.score(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), numbers, bias)
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-5)


@pytest.mark.parametrize("module", [toxicity, line_crf])
def test_classifiers_take_anything(spark, module):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.classify(docs, none).count() == docs.count()
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = module.classify(docs, some).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert not next(r for r in rows if r.doc_id is None).held_out
    assert module.classify(docs.limit(0), some).count() == 0


def test_unseen_spellings_share_pieces():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeioulnrt"), 5)) for _ in range(200)]
    texts, labels = [], []
    for i in range(400):
        words = rng.choice(plain, 30).tolist()
        if i % 2:
            words[int(rng.integers(30))] = "bastardly"
        texts.append(" ".join(words))
        labels.append(i % 2)
    numbers, bias = toxicity.train(texts, np.array(labels), updates=1200)
    score = lambda t: toxicity.score(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), numbers, bias)[0]
    assert score(" ".join(plain[:20]) + " bastardli") > 0.5 > score(" ".join(plain[:20]))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    bounds = np.array([0, 3, 3, 4, 8])
    scores, pairs = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected, total = line_crf.marginals(scores, bounds, pairs)
    want_good, want_pairs, want_total = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(bounds):
        if a == b:
            continue
        paths = list(itertools.product((0, 1), repeat=b - a))
        w = np.array([sum(scores[a + i] * y for i, y in enumerate(p)) + sum(pairs[x, y] for x, y in itertools.pairwise(p)) for p in paths])
        z = np.log(np.exp(w).sum())
        want_total += z
        for p, q in zip(paths, np.exp(w - z), strict=True):
            want_good[a:b] += q * np.array(p)
            for x, y in itertools.pairwise(p):
                want_pairs[x, y] += q
    assert np.allclose(good, want_good) and np.allclose(expected, want_pairs) and np.isclose(total, want_total)


def test_crf_gradient_is_that_of_the_likelihood():
    texts = ["good words here.\nand more words.\nthird.", "BAD!! BAD!!\nBAD!! BAD!!", "x | y | z\nfine words end.", "one"]
    raw = [t.encode() for t in texts]
    chains = line_crf.Chains(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    y = np.repeat([1.0, 0, 0, 1], np.diff(chains.bounds))
    w, pairs = np.random.default_rng(1).normal(0, 0.1, line_crf.N_FEATURES), np.array([[0.2, -0.1], [0.3, 0.1]])
    value = lambda w: (chains.scores(w) * y).sum() - line_crf.marginals(chains.scores(w), chains.bounds, pairs)[2]
    got = chains.gradient(y - line_crf.marginals(chains.scores(w), chains.bounds, pairs)[0])
    for i in [*range(0, line_crf.N_FEATURES, 17), -1, -2, -3]:
        step = np.zeros_like(w)
        step[i] = 1e-5
        assert np.isclose(got[i], (value(w + step) - value(w - step)) / 2e-5, atol=1e-5)


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 2000 else None
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_rules_against_brute_force(spark):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = spark.createDataFrame([(1000 + r.doc_id, r.text) for r in some], "doc_id long, text string").unionByName(odd_docs(spark).select("doc_id", "text")).repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == len(some) + len(ODD) + 2
    for r in rows:
        n, chars, symbols, dup, repeat = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and (not r.kept or not r.base_failed) and 0 <= r.quality <= 1
    votes = np.array([[ord(c) - 48 for c in r.votes] for r in rows], np.uint8)
    assert np.allclose(quality_rules.fit(votes, np.ones(len(votes))), [r.quality for r in rows], atol=1e-6)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert quality_rules.judge(docs.limit(0)).count() == 0 == quality_rules.keep_good(docs.limit(0)).count()


def test_estimates_find_good_rules():
    rng = np.random.default_rng(5)
    good = rng.random(4000) < 0.8
    kind = rng.integers(0, 3, 4000)
    votes = np.full((4000, len(quality_rules.RULES)), 1, np.uint8)
    for j in range(3):
        votes[~good & (kind == j) & (rng.random(4000) < 0.9), j] = 0
    votes[rng.random(votes.shape) < 0.1] = 2
    p = quality_rules.fit(votes, np.ones(4000))
    fired = (votes == 0).any(1)
    assert (p[fired] < 0.5).all() and (p[~fired] > 0.5).all()


def test_one_vote_of_an_unreliable_rule_does_not_reject():
    """Four rules agree on the bad documents; the last one fires at random on all."""
    rng = np.random.default_rng(6)
    good = rng.random(4000) < 0.8
    votes = np.full((4000, len(quality_rules.RULES)), 1, np.uint8)
    for j in range(3, 7):
        votes[~good & (rng.random(4000) < 0.8), j] = 0
    votes[rng.random(4000) < 0.15, -1] = 0
    votes[rng.random(votes.shape) < 0.1] = 2
    p = quality_rules.fit(votes, np.ones(4000))
    fired = votes == 0
    alone, several = fired[:, -1] & (fired.sum(1) == 1), fired[:, 3:7].sum(1) >= 2
    assert alone.sum() > 300 and several.sum() > 600
    assert (p[alone] > 0.5).all() and (p[several] < 0.5).all() and (p[~fired.any(1)] > 0.5).all()


def plain_estimate(votes, rounds=300):
    """The posterior of "good" with one class of each kind."""
    fires, passes = (votes == 0).astype(float), (votes == 1).astype(float)
    p = passes.sum(1) / np.maximum((fires + passes).sum(1), 1)
    for _ in range(rounds):
        by = np.column_stack([p, 1 - p])
        rates = (by.T @ fires + 0.05) / (by.T @ (fires + passes) + 1)
        odds = np.log(by.sum(0) + 0.1) + fires @ np.log(rates).T + passes @ np.log1p(-rates).T
        p = 1 / (1 + np.exp(odds[:, 1] - odds[:, 0]))
    return p


@pytest.mark.parametrize(("exclusive", "plain_too"), [(False, True), (True, False)])
def test_a_random_rule_is_outvoted(exclusive, plain_too):
    """Three sound rules, on the same junk or on junk of their own each, and one that votes bad at random on 30 %."""
    rng = np.random.default_rng(0)
    good, kind = rng.random(20_000) < 0.8, rng.integers(0, 3, 20_000)
    votes = np.ones((20_000, 4), np.uint8)
    for j in range(3):
        votes[~good & ((kind == j) | (not exclusive)) & (rng.random(20_000) < 0.9), j] = 0
        votes[good & (rng.random(20_000) < 0.02), j] = 0
    votes[rng.random(20_000) < 0.3, 3] = 0
    p, plain = quality_rules.fit(votes, np.ones(20_000)), plain_estimate(votes)
    alone = (votes[:, 3] == 0) & ((votes == 0).sum(1) == 1)
    assert (p[alone] > 0.5).all() and ((p > 0.5) == good).mean() > 0.9
    assert ((votes == 0).any(1) != good).mean() < 0.75 < ((p > 0.5) == good).mean()
    assert (((plain > 0.5) == good).mean() > 0.9) == plain_too and ((p > 0.5) == good).mean() >= ((plain > 0.5) == good).mean() - 0.002


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts = [*ODD, "  two  spaces ", "漢字🙂 mixed é́", "<s> </s> <unk> <0x41>", "a" * 300, "\x00\x01", "1234567890", *some]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in sentencepiece_codec.encode(docs, PIECES, with_ids=True).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        assert list(rows[i].ids) == want and rows[i].n_pieces == len(want) and rows[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert rows[i].round_trip == (library.decode(want) == (t or ""))
    back = sentencepiece_codec.decode(spark.createDataFrame([(i, list(rows[i].ids)) for i in range(len(texts))] + [(-1, None)], "doc_id long, ids array<int>"), PIECES)
    assert {r.doc_id: r.text for r in back.collect()} == {i: library.decode(library.encode(t or "")) for i, t in enumerate(texts)} | {-1: ""}
    assert None in rows and sentencepiece_codec.encode(docs.limit(0), PIECES).count() == 0


def test_sentencepiece_equals_the_library_on_run_together_pieces():
    import sentencepiece

    library, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(PIECES, most=500), random.Random(1)
    pieces = [*codec.rank]
    texts = ["".join(rng.choice(pieces) if rng.random() < 0.7 else rng.choice(["aa", "  ", "\n", "é", "漢", "====", "aaaa", "▁", "▁▁"]) for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    for i in range(0, 4000, 400):
        for text, ids in zip(texts[i : i + 400], codec.encode(texts[i : i + 400]), strict=True):
            assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids)


def test_sentencepiece_word_tables_change_nothing():
    small, large = sentencepiece_codec.Codec(PIECES, most=2), sentencepiece_codec.worker_codec(PIECES)
    texts = ["alpha beta alphabet", "beta alp", "alpha betas", "alphabets alpha"] * 2
    assert [small.encode([t]) for t in texts] == [[x] for x in large.encode(texts)]
