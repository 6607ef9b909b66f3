"""Encoding, decoding and alignment of tokens against the tokenizers' own libraries."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe as B
from quire.llm import queries as Q

ODD = st.lists(st.sampled_from([*" \n\t\r\x0b\x85\xa0aab'sste’1²!<>|", "日本", "ʼ", "ɐ", "̈", "𝔘", "İ", "ǆ", "<|endoftext|>", " the", "ing", "  ", "aaaa", "!!!!"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(B.vocabulary_path())


def library_ids(text, special=True):
    tokenizer = B.library(B.vocabulary_path())
    tokenizer.encode_special_tokens = not special
    try:
        return tokenizer.encode(text, add_special_tokens=False).ids
    finally:
        tokenizer.encode_special_tokens = False


@settings(max_examples=600, deadline=None)
@given(text=st.one_of(ODD, st.text(max_size=60)))
def test_encoder_gives_the_librarys_ids(encoder, text):
    ids = np.frombuffer(encoder.encode(text), np.int32)
    assert ids.tolist() == library_ids(text)
    assert np.frombuffer(encoder.ordinary(text), np.int32).tolist() == library_ids(text, special=False)
    assert B.decoder_of(encoder.path).decode(ids).decode() == text == B.library(encoder.path).decode(ids.tolist(), skip_special_tokens=False)


def test_one_last_token_for_every_prefix(encoder):
    """Of the tokens that a prefix ends with, exactly one is compatible with what comes before."""
    text = " antidisestablishmentarianismaaaaaaabababab"
    last = {0: None}
    for n in range(1, len(text) + 1):
        ends = [i for i, b in encoder.vocabulary.bytes_of.items() if i != 50256 and text[:n].encode().endswith(b)]
        fit = [i for i in ends if (before := last[n - len(encoder.vocabulary.bytes_of[i])]) is None or encoder.vocabulary.compatible(before, i)]
        assert len(fit) == 1
        last[n] = fit[0]
    assert all(encoder.vocabulary.reachable(i) for i in encoder.vocabulary.bytes_of)


def test_long_pieces_and_split_characters(encoder):
    rng = np.random.default_rng(3)
    for text in ("a" * 20_000, "".join(rng.choice(list("abcdehilnorst"), 20_000)), " " * 5000 + "x", "\n " * 3000):
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library_ids(text)
    half = library_ids("日")[:1]
    assert B.decoder_of(encoder.path).decode(np.array([*half, 99_999, -1], np.int32)).decode("utf-8", "replace") == B.library(encoder.path).decode(half, skip_special_tokens=False)


def test_memory_of_units_is_bounded():
    known = B.Known(lambda t: t.encode(), most=10)
    assert [known[str(i % 37)] for i in range(500)] == [str(i % 37).encode() for i in range(500)]
    assert len(known) <= 10 and len(known.older) <= 10


def test_encode_and_decode_odd_rows(spark, odd_docs, no_docs):
    out = B.digests(B.decode(B.encode(odd_docs)))
    want = sorted((repr(r.doc_id), len(ids := library_ids(r.text or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), r.size) for r in odd_docs.collect())
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.size) for r in out.collect()) == want
    assert B.digests(B.decode(B.encode(no_docs))).count() == 0


def test_query_equals_the_library(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op11_bpe(spark, small).collect()}
    assert got == {i: (len(ids := library_ids(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
