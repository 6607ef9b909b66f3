"""Learnt operators: what they can learn, held-out accuracy, brute force and odd input."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language_model as L
from quire.llm import quality_model as Q
from quire.llm import toxicity as T
from quire.llm.common import split_remainder
from quire.llm.tokens import shingle_sets, words


def test_pairs_of_terms_are_learnt():
    """Toxic only where an insult and a group meet: no sum of weights of single terms can say that."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        fill = [f"w{k}" for k in rng.integers(0, 30, 8)]
        texts.append(" ".join(fill + ["zzinsult"] * a + ["qqgroup"] * b))
        y.append(float(a and b))
    y = np.array(y)
    docs = [np.array(T.features(t), np.int64) for t in texts]
    fm = T.fit(docs[:900], y[:900], epochs=40, dropout=0.0)
    got = fm.scores(texts[900:], {}) > 0.5
    assert (got == (y[900:] > 0.5)).mean() > 0.97
    linear = T.FactorizationMachine(np.array(sorted({k for d in docs for k in d})), 0.0, np.zeros(1), np.zeros((1, 1)))
    assert linear.term and fm.v.std() > 0


def test_factorization_formula():
    keys = np.array([4 * 11, 4 * 12, 4 * 13], np.int64)
    rng = np.random.default_rng(1)
    fm = T.FactorizationMachine(keys, 0.3, rng.normal(size=3), rng.normal(size=(3, 2)))
    got = fm.margins(np.array([0, 2, 1]), np.array([2, 2, 3]))
    want = [0.3 + fm.w[0] + fm.w[2] + fm.v[0] @ fm.v[2], 0.3, 0.3 + fm.w[1]]
    assert np.allclose(got, want)


def test_toxicity_on_odd_documents(odd_docs, no_docs, no_labels, spark):
    for labels in (no_labels, spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int"), spark.createDataFrame([(5, 1, 1), (5, 0, None), (9, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")):
        model = T.learn(odd_docs, labels, F.lit(True))
        got = T.score_ids(odd_docs, model).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = T.score(odd_docs, model)
    assert kept.columns == [*odd_docs.columns, "__score"] and odd_docs.columns[-1] != "__score"
    assert T.score_ids(no_docs, model).count() == 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = T.learn(docs, labels, split_remainder(3) != 1)
    r = T.score_ids(docs, model).join(labels, "doc_id").filter(split_remainder(3) == 1).toPandas()
    hit = r.score >= 0.7
    assert (hit & (r.toxic == 1)).sum() / (r.toxic == 1).sum() > 0.85
    assert (hit & (r.toxic == 0)).sum() / (r.toxic == 0).sum() < 0.01


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    described = Q.describe(docs).cache()
    model = Q.fit(described, labels, split_remainder(5) != 0)
    r = Q.score(described, model).join(labels, "doc_id").filter(split_remainder(5) == 0).toPandas()
    assert ((r.score >= 0.3) == (r.quality == 1)).mean() > 0.93


def test_quality_on_odd_documents(odd_docs, no_docs, no_labels, spark):
    described = Q.describe(odd_docs).cache()
    one = spark.createDataFrame([(4, 1, 0)], "doc_id bigint, quality int, toxic int")
    two = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (5, 1, 0), (5, None, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    for labels, want in ((no_labels, 0.5), (one, 1.0), (two, None)):
        got = [r["score"] for r in Q.score(described, Q.fit(described, labels, F.lit(True))).collect()]
        assert len(got) == odd_docs.count() and all(0 <= s <= 1 for s in got)
        assert want is None or set(got) == {want}
    assert Q.score(Q.describe(no_docs), Q.fit(described, two, F.lit(True))).count() == 0


def test_kernel_and_isotonic():
    rng = np.random.default_rng(2)
    m = Q.Model(np.zeros(3), np.ones(3), rng.normal(size=(3, 4000)), rng.uniform(0, 2 * math.pi, 4000), np.zeros(4004), np.zeros(0), np.zeros(0))
    x = rng.normal(size=(20, 3))
    z = m.features(x)[:, :4000]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2)
    assert np.abs(z @ z.T - want).max() < 0.1
    knots, values = Q.isotonic(np.arange(5.0), np.array([0.0, 1.0, 0.5, 0.2, 1.0]), np.ones(5))
    assert (np.diff(values) >= 0).all() and np.isclose(np.interp(1.0, knots, values), (1 + 0.5 + 0.2) / 3)


def test_word_hashes():
    import pyarrow as pa

    texts = ["The cat  sat", "", "the\tCAT", None, "É é", "cat" * 500, "a\x0bb\x1fc"]
    column = pa.array(["" if t is None else t for t in texts])
    found = {}
    rows = []
    for _, h, _, bounds in words(column):
        rows += [h[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    import re

    for t, hs in zip(texts, rows, strict=True):
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        assert len(ws) == len(hs)
        for w, h in zip(ws, hs, strict=True):
            assert found.setdefault(w, h) == h
    assert len(set(found.values())) == len(found)
    sets = list(shingle_sets(pa.array(["a b c d e", "A b c d", "a b", "", "a b c d a b c d"]), 4))
    assert [len(s) for s in sets] == [2, 1, 1, 0, 4] and set(sets[1]) <= set(sets[0])


def tiny_vocabulary(counts):
    tokens = np.array(sorted(counts, key=lambda k: (-counts[k], k)))
    c = np.array([counts[k] for k in tokens])
    tail = L.tail_of(tokens)
    head = 2
    n, v = np.bincount(tail, c, L.TAIL), np.bincount(tail, minlength=L.TAIL).astype(float)
    n -= np.bincount(tail[:head], c[:head], L.TAIL)
    v -= np.bincount(tail[:head], minlength=L.TAIL)
    unit = L.HEAD + tail
    unit[:head] = np.arange(head)
    order = np.argsort(tokens)
    return L.Vocabulary(tokens[order], np.log10(c[order] + 1.0), unit[order], int(c.sum()), len(tokens), head, c[:head].astype(float), n, v)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    counts = {int(k): int(n) for k, n in zip(rng.integers(-(1 << 60), 1 << 60, 500), rng.integers(1, 50, 500), strict=True)}
    v = tiny_vocabulary(counts)
    net = L.Network.start(v)
    h = rng.normal(0, 0.5, (4, L.HIDDEN)).astype(np.float32)
    for state in h:
        head = np.exp(net.log_probability(np.tile(state, (L.HEAD, 1)), np.arange(L.HEAD))).sum()
        share = np.exp(net.log_probability(np.tile(state, (L.TAIL, 1)), L.HEAD + np.arange(L.TAIL)))  # class share / (N + V + 1)
        tail = (share * (v.tail_words + v.tail_kinds + 1)).sum()  # all words of a class, and one unseen
        assert abs(head + tail - 1) < 1e-4


def test_state_is_carried_through_whole_documents():
    rng = np.random.default_rng(4)
    v = tiny_vocabulary({int(k): 5 for k in rng.integers(0, 1 << 60, 50)})
    net = L.Network.start(v)
    lengths = [300, 1, 40, 40, 7]
    docs = [rng.integers(0, L.HEAD + L.TAIL, n) for n in lengths]
    got = L.score_units(net, np.concatenate(docs), np.cumsum(lengths), 0, block=64)
    for d, g in zip(docs, got, strict=True):
        h, previous, total = np.zeros((1, L.HIDDEN), np.float32), np.array([0]), 0.0
        for u in d:
            h = net.step(previous, h)
            total += net.log_probability(h, np.array([u]))[0]
            previous = np.array([u])
        assert abs(total - g) < 1e-3 * abs(total)


def test_gradients_by_differences():
    """One step of training lowers the loss it was computed from, and a learnt network predicts a fixed pattern."""
    v = tiny_vocabulary({k << 6: 100 - k for k in range(1, 40)})
    pattern = np.array([0, 1, 1, 0, 0, 1] * 60)
    net = L.train(L.Network.start(v), [pattern] * 12, streams=8, window=16, epochs=8)
    trained = L.score_units(net, pattern, np.array([len(pattern)]), 0)[0] / len(pattern)
    fresh = L.score_units(L.Network.start(v), pattern, np.array([len(pattern)]), 0)[0] / len(pattern)
    assert trained > fresh + 0.5


def test_language_model_on_odd_documents(odd_docs, no_docs):
    got = L.score(odd_docs, F.coalesce(F.col("doc_id") != 6, F.lit(True)), sample_docs=5).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r["n_tokens"] >= 1 and r["score"] <= 0 and r["base_score"] <= 0 and r["n_known"] <= r["n_tokens"]
    empty = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert {r["n_tokens"] for r in empty} == {1} and len({r["score"] for r in empty}) == 1
    assert L.score(no_docs, F.lit(True)).count() == 0
    none = L.score(odd_docs, F.lit(False)).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(r["n_known"] == 0 for r in none)


def test_language_model_beats_its_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = L.score(docs, split_remainder(7) != 2).filter(split_remainder(7) == 2).toPandas()
    assert r.score.sum() > r.base_score.sum()


def test_language_model_learns_from_every_training_document(spark, monkeypatch):
    """Words of their own in each document, and documents beyond the driver's sample: all reach the network."""
    docs = spark.createDataFrame([(i, f"common{i % 3} own{i} other{i} common{i % 5}") for i in range(200)], "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(L, "PART_TOKENS", 300)
    voc = L.vocabulary(L.count_tokens(docs))
    start, net = L.Network.start(voc), L.learn(docs, voc, 8)
    assert (start.x[: voc.head_size] != net.x[: voc.head_size]).any(1).all()
    assert all(np.isfinite(p).all() and p.dtype == np.float32 for p in net.parameters())
    assert all((a == b).all() for a, b in zip(net.parameters(), L.learn(docs, voc, 8).parameters(), strict=True))


def test_refining_averages_by_occurrence(spark, monkeypatch):
    """A round over two equal partitions is the round over one of them."""
    monkeypatch.setattr(L, "PART_TOKENS", 100)
    docs = spark.createDataFrame([("a b a c d a b",)] * 40, "text string")
    voc = L.vocabulary(L.count_tokens(docs))
    one, two = (L.refine(L.Network.start(voc), d, voc, 0.01) for d in (docs.limit(20).coalesce(1), docs.limit(20).coalesce(1).union(docs.limit(20).coalesce(1))))
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(one.parameters(), two.parameters(), strict=True))
    assert not np.allclose(one.x, L.Network.start(voc).x)


@pytest.mark.parametrize("known", [1, 1 << 10])
def test_rare_words_are_counted_exactly(spark, monkeypatch, known):
    monkeypatch.setattr(L, "KNOWN", known)
    docs = spark.createDataFrame([(0, "a b b c"), (1, "b c c d"), (3, "z b")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in L.score(docs, F.col("doc_id") < 3).collect()}
    n, v, c = 10, 5, {"a": 1, "b": 3, "c": 3, "d": 1, None: 2}
    base = lambda ws: sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in ws)
    assert abs(got[0]["base_score"] - base(["a", "b", "b", "c", None])) < 1e-9
    assert abs(got[3]["base_score"] - base(["z", "b", None])) < 1e-9 and got[3]["n_known"] == 2 and got[3]["train_tokens"] == n


def test_backpropagation_equals_differences():
    """Every kind of parameter, over a window with documents that begin in it, in double precision."""
    v = tiny_vocabulary({k << 6 | k % 3: 100 - k for k in range(1, 40)})
    rng = np.random.default_rng(11)
    net = L.Network.start(v)
    for name in ("x", "u", "wc", "bc", "wo", "bo"):
        setattr(net, name, getattr(net, name).astype(float))
    steps, streams = 6, 5
    unit, goal = (rng.choice(np.r_[0:2, L.HEAD : L.HEAD + L.TAIL], (steps, streams)) for _ in range(2))
    fresh, begin = rng.random((steps, streams)) < 0.3, rng.normal(0, 0.3, (streams, L.HIDDEN))

    def loss():
        h, total = begin, 0.0
        for s in range(steps):
            h = net.step(unit[s], np.where(fresh[s][:, None], 0, h))
            total -= net.log_probability(h, goal[s]).sum()
        return total / unit.size

    found, _ = L.gradients(net, unit, goal, fresh, begin)
    for p, g in zip(net.parameters(), found, strict=True):
        p, g = p.reshape(-1), g.reshape(-1)
        for i in [*np.argsort(-np.abs(g))[:6], *rng.integers(0, len(p), 3)]:
            was, values = p[i], []
            for e in (1e-5, -1e-5):
                p[i] = was + e
                values.append(loss())
            p[i] = was
            assert abs((values[0] - values[1]) / 2e-5 - g[i]) < 1e-6 + 1e-4 * abs(g[i])


def test_distinct_by_row():
    token, times = L.distinct_by_row(np.array([0, 0, 2, 0, 2]), np.array([7, 5, 9, 7, 9]), 4)
    assert [t.tolist() for t in token] == [[5, 7], [], [9], []] and [t.tolist() for t in times] == [[1, 2], [], [2], []]
    assert [len(t) for t in L.distinct_by_row(np.zeros(0, int), np.zeros(0, int), 3)[0]] == [0, 0, 0]


def test_features_are_chosen_as_by_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 12)) + " insult" * int(i % 4 == 0 and rng.random() < 0.8), int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = T.learn(docs, labels, F.lit(True), max_features=50)
    found, y = [np.array(T.features(t), np.int64) for _, t, _ in rows], np.array([float(y) for _, _, y in rows])
    want = T.fit(found, y, max_features=50)
    assert np.allclose(got.scores([t for _, t, _ in rows], {}), want.scores([t for _, t, _ in rows], {}), atol=1e-5)
    plain = []
    for text in [t for _, t, _ in rows[:20]]:  # the whole score, feature by feature
        counts = Counter(h for piece in text.split() for h in T.term_hashes(piece))
        has = [(h, i) for h, n in counts.items() for i, least in enumerate(T.LEVELS) if n >= least and h in got.term and got.row[got.term[h], i] >= 0]
        at = [got.row[got.term[h], i] for h, i in has]
        z = got.w0 + sum(got.w[k] for k in at) + sum(got.v[a] @ got.v[b] for i, a in enumerate(at) for b in at[:i])
        plain.append(1 / (1 + math.exp(-z)))
    assert np.allclose(got.scores([t for _, t, _ in rows[:20]], {}), plain, atol=1e-4)


@pytest.mark.parametrize("known", [1, 7, 3000])
def test_tokens_are_found_by_their_first_bits(monkeypatch, known):
    """op7: many tokens are looked up in a directory of their first bits, not by halving the whole table."""
    rng = np.random.default_rng(5)
    token = np.unique(np.r_[np.iinfo(np.int64).min, rng.integers(-(1 << 63), 1 << 63, known, dtype=np.int64), np.iinfo(np.int64).max])
    v = L.Vocabulary(token, np.zeros(len(token)), np.zeros(len(token), int), 1, 1, 0, np.zeros(0), np.zeros(L.TAIL), np.zeros(L.TAIL))
    asked = np.r_[rng.choice(token, 6000), rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64), token - 1, token + 1]
    monkeypatch.setattr(L.np, "searchsorted", None)
    for wanted in (token, token[1:-1]):  # the second without the least and the largest
        v.token = wanted
        v.__dict__.pop("directory", None)
        at, found = v.find(asked)
        assert (found == np.isin(asked, wanted)).all() and (wanted[at[found]] == asked[found]).all()


def test_rows_are_summed_by_unit():
    """op7: gradients of the inputs, for units with no, one, some and many tokens."""
    rng = np.random.default_rng(6)
    unit = np.r_[np.full(100, 3), np.full(17, 8), np.full(16, 5), rng.integers(9, 40, 60)]
    rng.shuffle(unit)
    rows = rng.normal(0, 1, (len(unit), 6))
    want = np.zeros((50, 6))
    np.add.at(want, unit, rows)
    assert np.allclose(L.sums_by_unit(rows, unit, 50), want) and np.allclose(L.sums_by_unit(rows, unit, 50, several=2), want)
