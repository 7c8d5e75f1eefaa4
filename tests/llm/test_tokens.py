"""Token counts and the codec against the library."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphmill.llm import bpe_codec, token_count
from graphmill.llm.bpe import Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "I'll", "don't", "’s", "ß", "中", "😀", "👩‍👩", "12", "½", "<|endoftext|>", "<|endof", "!!", "aaaaaaa", "\x00", "́", "Ǆ", "_"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(3)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(3000)] + ["", "a" * 5000, " " * 999, "ab" * 3000]


def test_counts_equal_the_library(vocabulary, library, samples):
    expected = [len(e.ids) for e in library.encode_batch(samples, add_special_tokens=False)]
    assert token_count.Counter(vocabulary).count(samples) == expected


def test_ids_and_text_equal_the_library(vocabulary, library, samples):
    codec = bpe_codec.Codec(vocabulary)
    got = codec.encode(samples)
    for text, raw, e in zip(samples, got, library.encode_batch(samples, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == e.ids
        assert codec.decode(raw).decode() == library.decode(e.ids, skip_special_tokens=False) == text


def test_forgetting_changes_nothing(vocabulary, samples, monkeypatch):
    expected = token_count.Counter(vocabulary).count(samples[:200])
    monkeypatch.setattr(token_count, "REMEMBERED", 3)
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 3)
    counter, codec = token_count.Counter(vocabulary), bpe_codec.Codec(vocabulary)
    for i in range(0, 200, 10):
        assert counter.count(samples[i : i + 10]) == expected[i : i + 10]
        assert [len(x) // 4 for x in codec.encode(samples[i : i + 10])] == expected[i : i + 10]


def test_queries_on_awkward_rows(docs, empty_docs, library):
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    counts = token_count.token_counts(docs, PATH)
    assert counts.columns == ["doc_id", "source", "lang", "n_chars", "n_bytes", "n_tokens", "over_limit"]
    expected = sorted((d is None, d or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in texts)
    assert sorted({(r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counts.collect()}) == expected
    trip = bpe_codec.bpe_round_trip(docs, PATH, keep_ids=True, keep_text=True)
    assert {(r.doc_id, r.decoded) for r in trip.collect()} == {(d, t or "") for d, t in texts}
    assert all(r.ids_sha256 == sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in trip.collect())
    assert token_count.token_counts(empty_docs, PATH).count() == bpe_codec.bpe_round_trip(empty_docs, PATH).count() == 0
