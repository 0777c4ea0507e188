"""Operators 4 and 5 against plain use of the tokenizers library."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltgrain.llm import packing, token_files, word_tokens
from siltgrain.llm.word_tokens import worker_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "Hello, WORLD!! don't 'tis 12½ a<|endoftext|>b <|startoftext|> x", "tab\tand\nline\x1cfs\x85nel\xa0nbsp", "É été ÀÉÎ ŒUVRE ﬁ é ́x İstanbul ſ ŉ ĸ Σίσυφος ΣΑΣ",
    "漢字 かな 한국어 🙂🙂", "a" * 5000, "word " * 3000, "x'S y'LL z'RE 'd", " em line　wide", "İİ ʼn K Å", "'''''s ''t", "²³¹ ¼ ٣٤ ª º µ",
]
SCHEMA = "doc_id long, text string, start int, ids string"


def reference_ids(texts, end):
    t = Tokenizer.from_file(PATH)
    return [np.array([*x.ids, end], np.uint32) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())


def table(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, 5, "clash") for i, t in enumerate(texts)], SCHEMA)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abzAZéÉßİſſΣς'’stdrlvm0½² \t\n\x1c\x85\xa0́<|>_-!$"), max_size=40), max_size=4))
def test_ids_equal_the_library(texts):
    ids, offsets = worker_tokenizer(PATH).encode([x.encode() for x in texts], 1)
    for i, want in enumerate(reference_ids(texts, 1)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want.tolist()


def test_words_of_vocabulary_tokens_equal_the_library():
    """Every token of the file by itself, and random ones run together."""
    byte = word_tokens._bytes_of_marks()
    with open(PATH) as f:
        plain = [bytes(byte[c] for c in t.removesuffix("</w>")).decode("utf-8", "ignore") for t in json.load(f)["model"]["vocab"]]
    rng = random.Random(2)
    texts = [" ".join(plain[i : i + 200]) for i in range(0, len(plain), 200)] + [" ".join("".join(rng.choices(plain, k=3)) for _ in range(50)) for _ in range(60)]
    ids, offsets = worker_tokenizer(PATH).encode([x.encode() for x in texts], 1)
    for i, want in enumerate(reference_ids(texts, 1)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want.tolist()


def test_a_long_plain_word_before_another_one_takes_no_time():
    text = "a" * 3000 + " " + "b" * 3000 + "漢"
    assert worker_tokenizer(PATH).encode([text.encode()], 1)[0].tolist() == reference_ids([text], 1)[0].tolist()


def test_a_small_word_table_changes_nothing():
    t = worker_tokenizer(PATH, most=3)
    for text, want in zip(ODD, reference_ids(ODD, 7), strict=True):
        assert t.encode([(text or "").encode()], 7)[0].tolist() == want.tolist()


def test_packing(spark):
    texts = [*ODD, *ODD, *[f"word{i} " * (i % 700) for i in range(300)]]
    want = reference_ids(texts, 0)
    docs = table(spark, texts).repartition(3)
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by_doc) == len(texts)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        ids = want[3 if doc is None else doc]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == ids.tolist()
        assert [r.start for r in pieces] == [2048 * i for i in range(len(pieces))] and [r.piece for r in pieces] == [*range(len(pieces))]
        assert all(r.length == 2048 for r in pieces[:-1])
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_open_sequences_stay_bounded_and_fit_best():
    packed, rng, free = packing.OpenSequences(100, 4), np.random.default_rng(1), {}
    for length in rng.integers(1, 101, 3000).tolist():
        fits = sorted((f, s) for s, f in free.items() if f >= length)
        before = dict(free)
        sequence, offset = packed.put(length)
        if fits:
            assert before[sequence] == fits[0][0] and offset == 100 - fits[0][0]
        else:
            assert offset == 0
            if len(free) == 4:
                free.pop(min((s for s in free), key=lambda s: (free[s], 0)) if len(set(free.values())) == 4 else next(s for s in free if free[s] == min(free.values()) and s not in {x for b in packed.by_free for x in b}))
        free[sequence] = 100 - offset - length
        if not free[sequence]:
            free.pop(sequence)
        assert len(free) == packed.n_open <= 4
        assert sorted(free.items()) == sorted((s, f) for f, b in enumerate(packed.by_free) for s in b)


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 70_000])
@pytest.mark.parametrize("kind", ["flat", "one", "steep"])
def test_segments_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"flat": rng.integers(0, 49408, n), "one": np.full(n, 5), "steep": np.minimum(rng.zipf(1.3, n), 49407)}[kind].astype(np.uint32)
    sizes = np.array([n // 2, n - n // 2])
    blob = token_files.encode_segment(ids, np.array([-5, token_files.NO_ID]), sizes, lanes=64, block=3000, every=7)
    got, doc_ids, got_sizes = token_files.decode_segment(blob)
    assert got.tolist() == ids.tolist() and doc_ids.tolist() == [-5, token_files.NO_ID] and got_sizes.tolist() == sizes.tolist()
    if n > 1000:
        bad = bytearray(blob)
        bad[-3] ^= 64
        with pytest.raises(ValueError):
            token_files.decode_segment(bytes(bad))


def test_a_block_decodes_from_each_checkpoint():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.2, 5000), 300).astype(np.uint32)
    freq = token_files.frequencies(np.bincount(ids))
    first = np.cumsum(freq) - freq
    assert freq.sum() == 1 << token_files.SCALE
    blob = token_files.encode_block(ids, freq.astype(np.uint64), first.astype(np.uint64), 32, 10)
    table = np.repeat(np.arange(len(freq)), freq).astype(np.uint32), freq.astype(np.uint64), first.astype(np.uint64)
    assert token_files.BLOCK.unpack_from(blob)[3] == 15
    for at in range(16):
        got, read = token_files.decode_block(memoryview(blob), table, 10, at)
        assert got.tolist() == ids[at * 320 :].tolist() and read == len(blob)


def test_frequencies_with_more_ids_than_room():
    counts = np.ones(1000, np.int64)
    counts[0] = 10**12
    freq = token_files.frequencies(counts)
    assert freq.sum() == 1 << token_files.SCALE and freq.min() == 1


def test_token_files(spark, tmp_path):
    texts = [*ODD, *ODD]
    want = reference_ids(texts, 1)
    docs = table(spark, texts).repartition(5)
    rows = {r.doc_id: r for r in token_files.encode_and_read(docs, PATH).collect()}
    start = 0
    for doc in [None, *(i for i in range(len(texts)) if i != 3)]:
        ids = want[3 if doc is None else doc]
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    token_files.write_tokens(docs, PATH, f"{tmp_path}/t", segment=1000)
    for r in token_files.read_tokens(spark, f"{tmp_path}/t", with_ids=True).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[3 if r.doc_id is None else r.doc_id].tolist() and r.start == rows[r.doc_id].start
    assert token_files.encode_and_read(docs.limit(0), PATH).count() == 0
    twice = docs.filter("doc_id = 5").unionAll(docs.filter("doc_id = 5"))
    assert sorted(r.start for r in token_files.encode_and_read(twice, PATH).collect()) == [0, len(want[5])]
