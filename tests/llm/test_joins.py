"""Similarity joins against brute force."""

import os
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm import embed_dedup as E
from quire.llm import jaccard as J
from quire.llm import mixing as M
from quire.llm import quality_rules as R
from quire.llm import toxicity as T
from quire.llm.components import components
from quire.llm.tokens import shingle_sets


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)] + [(2000, 2000 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = groups_of(edges, {n for e in edges for n in e})
    alone = {n for n in want if all(n not in e for e in edges if e[0] != e[1])}
    assert got == {n: c for n, c in want.items() if n not in alone}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def near_copies():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: rng.choice(vocabulary, n).tolist()
    docs = []
    passage = text(60)
    for _ in range(12):  # families of near copies
        base = text(int(rng.integers(8, 120)))
        for _ in range(6):
            t = list(base)
            for _ in range(int(rng.integers(0, 3))):
                t[int(rng.integers(0, len(t)))] = "edit" + str(rng.integers(0, 99))
            docs.append(t)
    docs += [passage + text(int(rng.integers(0, 40))) for _ in range(90)]  # a passage that many share, some little more
    docs += [text(int(rng.integers(0, 8))) for _ in range(30)]
    return [" ".join(t) for t in docs] + [docs and " ".join(docs[0]).upper()]


def brute_groups(texts, size, percent):
    sets = [set(s.tolist()) for s in shingle_sets(pa.array(texts), size)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return groups_of(pairs, range(len(texts))), sets


@pytest.mark.parametrize(("frequent", "very", "short", "block"), [(20, 512, 48, 512), (3, 6, 4, 8), (2, 3, 2, 4)])
@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, monkeypatch, frequent, very, short, block, size, percent):
    for name, value in (("FREQUENT", frequent), ("VERY_FREQUENT", very), ("SHORT_BUCKET", short), ("BLOCK", block)):
        monkeypatch.setattr(J, name, value)
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in J.with_smallest_id(J.similar_groups(J.numbered(docs), size, percent)).collect()}
    want, sets = brute_groups(texts, size, percent)
    assert got == {i: (want[i], len(sets[i])) for i in range(len(texts))}
    kept = {r["doc_id"] for r in J.keep_one(docs, size, percent).collect()}
    assert kept == {i for i in want if want[i] == i}


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_similar_sets_share_a_signature(data):
    """Any two similar, different sets have a single token or a combination in common, whatever is frequent."""
    n = data.draw(st.integers(4, 120))
    percent = data.draw(st.sampled_from([80, 85, 90]))
    rng = np.random.default_rng(data.draw(st.integers(0, 1 << 30)))
    base = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
    x, y = base.copy(), base.copy()
    for k in range(data.draw(st.integers(1, max(1, n // 8)))):
        if k % 2:
            x = np.delete(x, int(rng.integers(0, len(x)))) if len(x) > 1 else x
        else:
            y = np.append(np.delete(y, int(rng.integers(0, len(y)))) if data.draw(st.booleans()) and len(y) > 1 else y, rng.integers(-(1 << 62), 1 << 62))
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y))
    if np.array_equal(x, y) or 100 * both < percent * (len(x) + len(y) - both):
        return
    every = np.union1d(x, y)
    frequent = every[rng.random(len(every)) < data.draw(st.sampled_from([0.0, 0.3, 0.9, 1.0]))]
    level = rng.choice([30, 60, 600, 5000], len(frequent))
    (a, ca), (b, cb) = (J.prefix_signatures(s, frequent, level, percent) for s in (x, y))
    assert set(a.tolist()) & set(b.tolist()) or set(ca) & set(cb)


def test_join_on_odd_documents(odd_docs, no_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.with_smallest_id(J.similar_groups(J.numbered(odd_docs))).collect()}
    assert [got[i] for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert got[5] == got[10] and got[10][1] == 5 and got[8] == (1, 8)
    assert J.with_smallest_id(J.similar_groups(J.numbered(no_docs))).count() == 0
    kept = J.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id IN (5, 10)").count() == 1
    assert J.keep_one(no_docs).count() == 0


def test_block_links():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 40, 50)
    sets = [np.unique(np.r_[base[: 50 - k % 5], rng.integers(0, 1 << 40, k % 3)]) for k in range(30)] + [np.unique(rng.integers(0, 1 << 40, 20)) for _ in range(5)]
    for side in (np.zeros(35, int), np.arange(35) % 2):
        found = J.block_links(sets, np.arange(35), side, 85, width=16)
        pairs = [(i, j) for i in range(35) for j in range(i) if (side[i] != side[j] or not side.any()) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        assert groups_of(found, range(35)) == groups_of(pairs, range(35)) and len(found) < 35


def vectors():
    rng = np.random.default_rng(7)
    rows = [rng.normal(size=8) for _ in range(60)]
    rows += [rows[0] + rng.normal(0, s, 8) for s in (0.0, 0.01, 0.1, 0.2, 0.3, 0.5)] + [3 * rows[1], -rows[2]]
    for _ in range(200):  # pairs close to the threshold
        a = rng.normal(size=8)
        b = rng.normal(size=8)
        a, b = a / np.linalg.norm(a), b - a * (a @ b) / (a @ a)
        b /= np.linalg.norm(b)
        c = 0.9 + rng.normal(0, 0.004)
        rows += [a, c * a + np.sqrt(1 - c * c) * b]
    return [r.astype(np.float32).tolist() for r in rows]


@pytest.mark.parametrize("tile", [16, 4096])
def test_tiles_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    rows = vectors()
    got = {r["vec_id"]: r for r in E.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<float>")).collect()}
    m = np.array(rows, np.float32).astype(np.float64)
    cos = (m @ m.T) / np.sqrt((m * m).sum(1))[:, None] / np.sqrt((m * m).sum(1))[None]
    np.fill_diagonal(cos, 0)
    want = groups_of(list(zip(*np.nonzero(cos >= 0.9), strict=True)), range(len(rows)))
    assert [got[i]["n_links"] for i in range(len(rows))] == (cos >= 0.9).sum(1).tolist()
    assert {i: got[i]["component_id"] for i in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_quantisation_bound():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = E.quantise(x)
    near = q * s[:, None]
    bound = e[:, None] * np.linalg.norm(near, axis=1)[None] + e[None]
    assert (np.abs(x @ x.T - near @ near.T) <= bound + 1e-12).all() and np.abs(q).max() <= 127


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [2.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("row", F.lit("x")).withColumn("e", F.lit(1))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in E.near_duplicates(df).collect())
    alone = [(str(i), 0, str(i)) for i in (2, 3, 4, 5, 6, 7, 8)]
    assert got == sorted([("1", 3, "1"), ("1", 3, "1"), ("9", 3, "1"), ("None", 3, "1"), *alone])
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_hot_keys_join(spark):
    """Keys of many rows by broadcast, others by shuffle: all rows once."""
    big = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k")
    facts = big.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    got = sorted(map(tuple, C.join_counted(big, facts, ["k"], "copies", 1000, hot=50).select("id", "k", "least").collect()))
    assert got == [(i, 0 if i % 3 == 0 else i, 0 if i % 3 == 0 else i) for i in range(1000)]


def test_numbered_copies(spark):
    rows = [(1, "a")] * 25 + [(None, "a")] * 11 + [(2, None)]
    df = spark.createDataFrame(rows, "x int, `y.z` string")
    got = Counter(C.numbered_copies(df, chunk=4).collect())
    assert got == Counter((x, y, i) for (x, y), n in Counter(rows).items() for i in range(n))


def test_components_of_hubs(spark, monkeypatch):
    from quire.llm import components as K

    monkeypatch.setattr(K, "HUB", 3)
    edges = [(7, i) for i in range(8, 60)] + [(i, i + 1) for i in range(100, 110)] + [(105, i) for i in range(200, 220)] + [(300, 301)]
    got = {r["node"]: r["component"] for r in K.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = groups_of(edges, {n for e in edges for n in e})
    assert got == want


def test_numbers_hold_whatever_the_splits(spark, tmp_path):
    """Rows are numbered once: a table scanned in other splits later gives the same groups."""
    texts = near_copies()
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = J.numbered(docs)
    first = {r["row"]: r["doc_id"] for r in rows.collect()}
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "40")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert {r["row"]: r["doc_id"] for r in rows.collect()} == first
        got = {r["doc_id"]: r["component_id"] for r in J.with_smallest_id(J.similar_groups(rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
    assert got == brute_groups(texts, 4, 85)[0]


def test_half_the_rows_are_copies_without_id(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_ROWS", 8)
    texts = near_copies()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])] * len(texts)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in J.with_smallest_id(J.similar_groups(J.numbered(docs))).collect())
    want, _ = brute_groups(texts, 4, 85)
    assert got == Counter([(i, want[i]) for i in want] + [(None, want[0])] * len(texts))
    assert J.keep_one(docs, 4, 85).count() == len(set(want.values()))


def test_many_copies_of_a_vector(spark):
    rows = list(enumerate(vectors()[:80])) + [(None, vectors()[3])] * 3000
    got = [r for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect() if r["vec_id"] in (3, None)]
    assert len(got) == 3001 and {(r["n_links"], r["component_id"]) for r in got} == {(3000, 3)}


@pytest.mark.parametrize("dim", [4, 64, 1200])
def test_open_pairs_do_not_depend_on_the_tile(dim):
    """What a tile leaves open, a part of the tile leaves open too, and bounds hold against exact cosines."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(60, dim))
    y = 0.9 * x / np.linalg.norm(x, axis=1)[:, None] + np.sqrt(0.19) * rng.normal(size=x.shape) / np.sqrt(dim)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    code = lambda v: E.Codes(*(a.astype(np.int8) if k == 0 else a for k, a in enumerate(E.quantise(unit(v)))), v)
    a, b = code(x), code(y)
    pairs = lambda left, right, k: {(int(i), int(j)) for found in E.decided_pairs(left, right, 0.9, False, 16) for i, j in zip(found[k], found[k + 1], strict=True)}
    sure, open_ = pairs(a, b, 0), pairs(a, b, 2)
    cos = unit(x) @ unit(y).T
    exact = {(int(i), int(j)) for i, j in zip(*np.nonzero(cos >= 0.9), strict=True)}
    assert sure <= exact <= sure | open_ and open_
    some = np.array(sorted({i for i, _ in open_})), np.array(sorted({j for _, j in open_}))
    again = {(int(some[0][i]), int(some[1][j])) for i, j in pairs(a.at(some[0]), b.at(some[1]), 2)}
    assert again == {(i, j) for i, j in open_}


def test_dotted_column_names(spark):
    docs = spark.createDataFrame([(i, f"some text of document {i}", "s", 1.5) for i in range(5)], "doc_id bigint, text string, source string, `a.b` double").withColumn("odd`name", F.lit(1)).withColumn("__score", F.lit("x"))
    for out in (J.keep_one(docs), M.mix(docs), R.keep_good(docs)):
        assert out.columns == docs.columns and out.count() <= 3 * 5
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    out = T.keep_below(docs, T.learn(docs, labels, F.lit(True)), 0.7)
    assert out.columns == docs.columns and out.count() > 0


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-324 * 2**40, 1.7e308])
def test_open_pairs_of_any_magnitude(size):
    v = np.array([[1.0, 1.0], [1.0, 1.0], [1.0, -1.0]]) * size
    c = E.Codes(np.zeros((3, 2)), np.zeros(3), np.zeros(3), v)
    assert E.exact_links(c, c, np.array([0, 0, 1]), np.array([1, 2, 2]), 0.9).tolist() == [True, False, False]


def test_rows_are_kept_by_bits(spark):
    """Many partitions and numbers, on both sides of a bitmap's end; none, some, all; repeated numbers; a shuffled join."""
    numbers = spark.range(0, 100_000, 1, 3).select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("v"))
    rows = C.materialize(numbers, "t")
    for some in ("false", "v % 7 = 3 OR v IN (0, 32767, 32768, 33333, 33334, 99999)", "true"):
        wanted = rows.filter(some).select(F.col("row").alias("w"))
        assert C.keep_rows(rows, "row", wanted.unionByName(wanted)).agg(F.count("v"), F.sum("v")).first() == rows.filter(some).agg(F.count("v"), F.sum("v")).first()


def test_texts_stay_where_they_are_beyond_the_broadcast_of_rows(spark, monkeypatch):
    """However many documents are kept, no plan shuffles their texts."""
    monkeypatch.setattr(C.small_side, "__defaults__", (0,))
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0, raising=False)
    docs = spark.createDataFrame(list(enumerate(near_copies())), "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = J.keep_one(docs, 4, 85)
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept.count() == len(set(brute_groups(near_copies(), 4, 85)[0].values()))


def test_a_written_step_leaves_no_shuffle(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {b for b in blocks.split() if b.startswith("shuffle_")}

    before, conf = shuffles(), spark.conf.get(key)
    written = C.materialize(spark.range(1000).repartition(3, "id"), "t")
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)  # they are deleted in the background
    assert not shuffles() - before and spark.conf.get(key) == conf
    assert written.count() == 1000


def test_files_of_a_step_go_after_use(spark):
    mark = C.scratch_mark()
    groups = J.similar_groups(J.numbered(spark.createDataFrame(list(enumerate(near_copies())), "doc_id bigint, text string")))
    gone = {f.split("/quire-")[1].split("-")[0] for f in C.scratch_since(mark) if not os.path.exists(f.removeprefix("file://"))}
    assert {"jaccard", "single", "sets"} <= gone
    assert groups.count() == len(near_copies())
