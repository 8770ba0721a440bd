import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import empty_docs, hard_docs, hard_texts, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from lakekit.llm import bpe, queries

RANKS = queries.rank_file()


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def ids(coded):
    return [np.frombuffer(c, "<i4").tolist() for c in coded]


def test_same_ids_as_the_library(reference, encoder):
    texts = [t or "" for t in hard_texts()]
    assert ids(encoder.encode(texts)) == [reference.encode_ordinary(t) for t in texts]


PARTS = st.sampled_from(["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "日", "12", "_", ".", "!!", "'s", "\x1c", " ", "Ⅷ", "er", "🙂"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=40).map("".join), max_size=5))
def test_same_ids_for_any_mix(texts):
    encoder = test_same_ids_for_any_mix.encoder
    library = test_same_ids_for_any_mix.library
    assert ids(encoder.encode(texts)) == [library.encode_ordinary(t) for t in texts]


@pytest.fixture(autouse=True, scope="module")
def given_tools(encoder, reference):
    test_same_ids_for_any_mix.encoder = encoder
    test_same_ids_for_any_mix.library = reference


def test_very_long_pre_token(reference, encoder):
    for text in ("x" * 30_000, "thereof" * 3_000, "abcde" * 2_000 + "edcba" * 2_000):
        assert ids(encoder.encode([text])) == [reference.encode_ordinary(text)]


def test_small_memory_gives_the_same(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for t in hard_texts():
        assert ids(encoder.encode([t or ""])) == [reference.encode_ordinary(t or "")]


def test_round_trip_and_clashing_names(spark, reference):
    docs = hard_docs(spark).withColumnRenamed("lang", "token_ids")
    out = bpe.digests(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(out) == docs.count()
    for r in out:
        expected = reference.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == sha(" ".join(map(str, expected)))
        assert r["decoded_sha256"] == sha(r["text"] or "")


def test_empty_table(spark):
    assert bpe.digests(bpe.encode(empty_docs(spark), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_digests_in_one_pass_are_those_of_two(spark):
    docs = hard_docs(spark).withColumnRenamed("lang", "n_tokens")
    two = bpe.digests(bpe.encode(docs.drop("n_tokens"), RANKS, public_tokenizers.PATTERN), RANKS).drop("text")
    one = bpe.encoded_digests(docs, RANKS, public_tokenizers.PATTERN)
    key = lambda r: str(r)
    assert sorted(map(tuple, one.select(*two.columns).collect()), key=key) == sorted(map(tuple, two.collect()), key=key)
    assert bpe.encoded_digests(empty_docs(spark), RANKS, public_tokenizers.PATTERN).count() == 0
