"""Ranked search against exhaustive scoring."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import lexical as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, t) for i, text in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df, counts, out = Counter(w for _, t in held for w in set(t)), [Counter(t) for _, t in held], []
    for item, text in items:
        found = []
        for (doc_id, t), tf in zip(held, counts, strict=True):
            m = 100 - 90 + (90 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in set(terms(text)) if tf[w])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, r, doc_id, -s) for r, (s, _, doc_id) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(map(repr, out))


def rows(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZ09 .,-_é日\x85 ß\n[`{@/:"), max_size=30))
def test_terms(text):
    assert [t.decode() for t in L.terms_of(text)] == terms(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=14), min_size=1, max_size=4))
def test_cuts_cost_least(lists):
    """Against all ways of cutting a list."""
    impacts, starts = np.array([x for xs in lists for x in xs]), np.cumsum([0, *map(len, lists)])[:-1]
    got, at = L.block_ends(impacts, starts), 0

    def cost(xs, cuts, fee):
        blocks = [xs[a:b] for a, b in zip([0, *cuts], [*cuts, len(xs)], strict=True)]
        return sum(max(b) * len(b) - sum(b) + fee for b in blocks)

    for xs in lists:
        fee = L.FEE * np.std(xs) + 1e-9
        mine = [i + 1 for i in np.flatnonzero(got[at : at + len(xs)])]
        assert mine[-1] == len(xs)
        every = ([i + 1 for i in range(len(xs) - 1) if bits >> i & 1] for bits in range(1 << len(xs) - 1))
        assert cost(xs, mine[:-1], fee) <= min(cost(xs, c, fee) for c in every) + 1e-6
        at += len(xs)


def test_walk_is_exact_and_skips():
    rng = np.random.default_rng(4)
    n_docs = 30_000
    postings = []
    for t in range(40):
        docs = np.sort(rng.choice(n_docs, int(rng.integers(1, n_docs // 2)), False))
        impact = rng.integers(1, 40, len(docs))
        impact[rng.choice(len(docs), max(1, len(docs) // 400), False)] = 400
        postings.append((np.full(len(docs), t), docs, impact))
    shard = L.Shard(*(np.concatenate(x) for x in zip(*postings, strict=True)), n_docs)
    scored = 0
    for _ in range(40):
        asked = [(int(t), int(rng.integers(0, 9))) for t in rng.choice(45, int(rng.integers(1, 12)), False)]
        want = np.zeros(n_docs, np.int64)
        for t, w in asked:
            if t < 40:
                want[postings[t][1]] += w * postings[t][2]
        order = np.lexsort((np.arange(n_docs), -want))
        order = order[want[order] > 0][:10]
        docs, scores, n = shard.search(asked, 10)
        assert docs.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
        scored += n
    assert scored < 40 * n_docs / 10


def test_search_equals_brute_force(spark, odd_docs):
    rng = np.random.default_rng(8)
    vocabulary = [f"W{i}" for i in range(60)]
    docs = [(int(i), " ".join(rng.choice(vocabulary, int(rng.integers(0, 40)), p=np.arange(60, 0, -1) / 1830))) for i in rng.integers(0, 150, 300)]
    docs += [(None, "w1 w2 w3"), (None, None), (7, ""), (8, "w50 " * 30_000), *[(900 + i, "w59, W58! copies") for i in range(40)]]
    items = [(1, "w1 w2 w3 w59"), (1, "w58-W59"), (2, None), (3, " ,. "), (None, "w0 w0 w50"), (4, "nobody"), (5, " ".join(vocabulary))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).selectExpr("*", "1 AS n", "'x' AS terms", "2 AS score")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert rows(L.search(d, q)) == want
    assert rows(L.search(d, q, block_terms=20)) == want  # several passes
    assert rows(L.search(odd_docs, q.union(spark.createDataFrame([(9, "dog quick END")], q.schema)))) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], [*items, (9, "dog quick END")])


@pytest.mark.parametrize("docs, items", [(0, 1), (1, 0)])
def test_nothing(spark, odd_docs, no_docs, docs, items):
    q = spark.createDataFrame([(1, "fox")], "item_id bigint, text string").limit(items)
    assert L.search(odd_docs if docs else no_docs, q).count() == 0
