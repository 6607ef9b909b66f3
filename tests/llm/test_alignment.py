"""Alignment of two tokenizers against a walk over all overlaps, with ids from the tokenizers' own libraries."""

import hashlib
from collections import Counter
from functools import lru_cache

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import alignment as A
from quire.llm import bpe as B
from quire.llm import queries as Q

PATH_B = public_tokenizers.path("piece_bpe_32k.model")
ODD = st.lists(st.sampled_from([*" \n\taab'ste’1!<>|", "日本", "ﬁ", "ａ", "̈", "𝔘", "İ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "  ", " the", "ing", "aaaa"]), max_size=30).map("".join)


@lru_cache(1)
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def library_tokens(text):
    """(id, bytes) of A and of B, none if either does not spell the text."""
    if not text:
        return [], []
    tokenizer, spelt = B.library(B.vocabulary_path()), B.spelling()
    tokenizer.encode_special_tokens = True
    try:
        ids = tokenizer.encode(" " + text, add_special_tokens=False).ids
    finally:
        tokenizer.encode_special_tokens = False
    a = [(i, bytes(spelt[c] for c in tokenizer.id_to_token(i))) for i in ids]
    b = []
    for i in pieces().encode(text):
        t = pieces().id_to_piece(i)
        b.append((i, bytes([int(t[3:5], 16)]) if pieces().is_byte(i) else t.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(docs):
    """Rows of RESULT for (doc_id, text) pairs."""
    facts, counts = [], Counter()
    for doc_id, text in docs:
        a, b = map(spans, library_tokens(text))
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        cuts = {e for _, _, e in a} & {e for _, _, e in b}
        groups, rest = [], [iter(a), iter(b)]
        for cut in sorted(cuts):
            inside = [[], []]
            for side, ids in zip(rest, inside, strict=True):
                for i, _, e in side:
                    ids.append(str(i))
                    if e == cut:
                        break
            groups.append("|".join(map(",".join, inside)))
        facts.append((doc_id, len(a), len(b), groups, links))
        counts.update(links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        repr((doc_id, a, b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        for doc_id, a, b, groups, links in facts
    )


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=30)), max_size=4))
def test_tokens_are_the_libraries(texts):
    for (ids, lengths, numbers), side in zip(A.tokens(texts, B.vocabulary_path(), PATH_B), (0, 1), strict=True):
        want = [library_tokens(t)[side] for t in texts]
        assert ids.tolist() == [i for t in want for i, _ in t]
        assert lengths.tolist() == [len(x) for t in want for _, x in t]
        assert numbers.tolist() == [*map(len, want)]


@pytest.mark.parametrize("block", [1, 200, A.BLOCK_BYTES])
def test_odd_rows_in_blocks_of_any_size(spark, odd_docs, no_docs, block):
    texts = ["a  b", " lead", "tail ", "<|endoftext|> as text", "▁mark", "日本語 text", "x" * 5000, "the\nline\n\n", "ﬁne ａ", "<s> <0x41>", "a" * 70 + " " + "a" * 70]
    docs = odd_docs.select("doc_id", "text", "size", "key").unionByName(spark.createDataFrame([(100 + i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, size string, key string"))
    assert rows(A.align(docs, block_bytes=block)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert A.align(no_docs).count() == 0


def test_only_rows_without_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id bigint, text string")
    assert rows(A.align(docs)) == brute([(1, None), (2, ""), (None, "▁")])


def test_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(Q.op13_align(spark, small)) == brute(docs)


def test_blocks_leave_no_ids_behind():
    """A worker holds no more after many blocks than after one."""
    import tracemalloc

    block = lambda k: A.align_block(k, [0], [" ".join(f"w{k}x{i * 7919 % 99991:x}" for i in range(8000))], B.vocabulary_path(), PATH_B)
    block(0)
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for k in (1, 2):
            block(k)
        assert tracemalloc.get_traced_memory()[0] - before < 1 << 20
    finally:
        tracemalloc.stop()


def test_runs_of_spaces_that_the_pattern_cannot_go_back_over():
    text = "a" + " " * 1_200_000 + "b"
    assert A.ordinary(B.vocabulary_path(), text) == B.encoder_of(B.vocabulary_path()).ordinary(text)
