import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from chromaloom.llm import bpe_transducer as bt
from chromaloom.llm import token_counts as tc
from tests.llm.cases import documents

PATTERN = public_tokenizers.PATTERN
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = [*"abcdez AEIO \n\t\r\x0b\x1c\x85\xa0　'0123٣²_-!?.éñßÖ中😀‍﻿\x00", "<|endoftext|>", "aaaa", "    ", "'ll", "  \n", "the", "ing"]


def fuzz(count, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 50))) for _ in range(count)] + ["a" * k for k in range(40)] + [" " * k for k in range(40)]


@pytest.fixture(scope="module")
def library():
    ranks = bt.read_ranks(open(RANKS).read())
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library():
    texts = fuzz(3000)
    counter = tc.TokenCounter(tc.MergeTable(open(JSON).read(), PATTERN))
    assert counter.counts(texts) == [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("alphabet, size", [("ab", 5000), ("a", 3000), ("etaoinshr", 20000), ("中文字的是了我", 30000), ("abcdefghijklmnopqrstuvwxyz", 60000)])
def test_long_pieces_equal_the_library(library, alphabet, size):
    text = "".join(random.Random(size).choices(alphabet, k=size))
    counter = tc.TokenCounter(tc.MergeTable(open(JSON).read(), PATTERN))
    assert counter.counts([text, "", text + " x"]) == [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch([text, "", text + " x"], add_special_tokens=False)]


def test_long_pieces_keep_the_states_bounded(library, monkeypatch):
    monkeypatch.setattr(bt, "CACHED_STATES", 300)
    codec = bt.Codec(bt.read_ranks(open(RANKS).read()), PATTERN)
    text = "".join(random.Random(4).choices("abcdefghij", k=8000))
    assert next(codec.encode([text])) == library.encode_ordinary(text)
    assert len(codec.transducer.states) <= 302


def test_transducer_equals_the_library(library, monkeypatch):
    texts = fuzz(3000, 2)
    codec = bt.Codec(bt.read_ranks(open(RANKS).read()), PATTERN)
    ids = list(codec.encode(texts))
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(i) for i in ids] == texts
    monkeypatch.setattr(bt, "CACHED_STATES", 50)
    monkeypatch.setattr(bt, "CACHED_PAIRS", 50)
    small = bt.Codec(bt.read_ranks(open(RANKS).read()), PATTERN)
    assert list(small.encode(texts[:400])) == ids[:400]


def test_rare_pieces_add_few_states(library):
    rng = random.Random(11)
    texts = [" " + "".join(rng.choices("etaoinshrdlu", k=24)) for _ in range(2000)]
    codec = bt.Codec(bt.read_ranks(open(RANKS).read()), PATTERN)
    assert list(codec.encode(texts)) == [library.encode_ordinary(t) for t in texts]
    assert len(codec.transducer.states) < 3 * len(texts)


def test_utf8_machine_equals_the_whole_decoder():
    rng = random.Random(3)
    for _ in range(5000):
        data = bytes(rng.choices([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE2], k=rng.randint(0, 12)))
        cut, machine = rng.randint(0, 12), bt.Utf8Machine()
        assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.finish() == data.decode("utf-8", "replace")


def test_awkward_documents(spark, library):
    docs = documents(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for row in tc.count_tokens(docs, JSON, PATTERN).collect():
        text = texts[row.doc_id]
        assert row.n_bytes == len(text.encode())
        assert row.n_tokens == len(library.encode_ordinary(text))
        assert row.over_limit == (row.n_tokens > 512)
    rows = bt.round_trip(docs, RANKS, PATTERN).collect()
    assert len(rows) == docs.count()
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids) and row.same_text
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    assert tc.count_tokens(docs.limit(0), JSON, PATTERN).count() == bt.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0
    encoded = bt.encode_documents(docs, RANKS, PATTERN)
    assert {r.doc_id: r.text for r in bt.decode_documents(encoded, RANKS, PATTERN).collect()} == texts
