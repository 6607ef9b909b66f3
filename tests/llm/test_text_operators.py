"""Rules, mixing, sharding, chat and packing against brute force, round trips and odd input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import chat, mixing, packing, quality_rules, sharding

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def brute_rules(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_on_odd_documents(odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.select("doc_id", "text").collect()}
    got = quality_rules.judge(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert quality_rules.judge(no_docs).count() == 0 and quality_rules.keep_good(no_docs).count() == 0
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns


def test_bad_host_goes(spark):
    good = "some words that are all of them different from each other in this text here now and then with more of them to come {}"
    rows = [(i, good.format(i) if i % 10 else "short", "good") for i in range(60)] + [(100 + i, "short" if i % 10 else good.format(i), "bad") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = quality_rules.judge(docs)
    assert {r["doc_id"] for r in out.filter("kept").collect()} == {i for i in range(60) if i % 10}
    assert out.filter("doc_id >= 100 AND NOT base_failed AND host_rejected").count() == 6


def fill_levels(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[q] for q in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    return target


def test_mix_on_odd_documents(odd_docs, no_docs):
    got = mixing.curriculum(odd_docs).collect()
    rows = odd_docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want = fill_levels(dict(sizes))
    taken, target = Counter(), {}
    assert len(got) == len(rows)
    source = {r["doc_id"]: r["source"] for r in rows}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s, t in target.items():
        assert t == pytest.approx(want[s]) and abs(taken[s] - t) <= 1
    positions = [r["position"] for r in got if r["position"] is not None]
    assert positions == sorted(positions) and all(0 <= x <= 1 for x in positions)
    assert mixing.curriculum(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.curriculum(odd_docs).collect()))


def test_schedule_inverse(spark):
    for knots in (*mixing.SCHEDULES, (0.0, 2.0), (1.0, 0.0, 1.0)):
        u = np.linspace(0.001, 0.999, 50)
        t = np.array([r[0] for r in spark.createDataFrame([(float(x),) for x in u], "u double").selectExpr(mixing.inverse_integral("u", knots)).collect()])
        grid = np.linspace(0, 1, 20001)
        w = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        area = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2)]
        assert np.allclose(np.interp(t, grid, area / area[-1]), u, atol=1e-4)


def test_mix_repeats_and_drops_documents(spark):
    rows = [(i, "w " * 10, "small") for i in range(4)] + [(100 + i, "w " * 10, "large") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    counts = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    plan = {r["doc_id"]: r for r in mixing.curriculum(docs).collect()}
    assert all(counts[i] == 3 for i in range(4)) and sum(counts[100 + i] for i in range(60)) < 60
    assert all(abs(counts[i] * 10 - plan[i]["taken"]) <= 5 for i in plan)


def test_hypergeometric():
    rng = random.Random(1)
    draws = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20_000))
    from math import comb

    for k in range(5):
        assert abs(draws[k] / 20_000 - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.015
    m = np.array(sharding.communication_matrix([10, 0, 25, 5], [13, 13, 14], 3))
    assert m.sum(1).tolist() == [10, 0, 25, 5] and m.sum(0).tolist() == [13, 13, 14]


@pytest.mark.parametrize("block", [3, 4096])
def test_shards(odd_docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", block)
    got = sharding.shard(odd_docs, 4).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in texts)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(4)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(no_docs).count() == 0


def test_shards_are_uniform(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got = np.array([(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs).collect()])
    assert (np.bincount(got[:, 1]) == 500).all()
    assert abs(np.corrcoef(got[:, 0], got[:, 2])[0, 1]) < 0.06
    half = np.bincount(got[got[:, 0] < 2000, 1], minlength=8)
    assert (np.abs(half - 250) < 60).all()


TEXTS = st.lists(st.sampled_from([*"<|>\\ab\n", "<|im_end|>", "<|im_start|>", "é"]), max_size=30).map("".join)


@settings(deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=6))
def test_chat_round_trip(turns):
    formatted, spans = chat.write_turns(turns, "a")
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[i:j]) for i, j in spans] == [t for r, t in turns if r == "a"]
    assert formatted.count("<|im_start|>") == formatted.count("<|im_end|>") == len(turns)


def test_layouts(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7}'), (2, '{"prompt": "q", "completion": "a"}'), (3, '{"instruction": "q", "input": "", "output": "a"}'),
        (4, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'), (5, '{"other": 1}'), (6, "not json"), (7, None), (8, "[1]"), (9, '{"completion": null, "prompt": "q"}'),
    ]
    got = {r["conv_id"]: r for r in chat.format_records(spark.createDataFrame(records, "conv_id bigint, record string")).collect()}
    assert {got[i]["formatted"] for i in (1, 2, 3, 4)} == {"<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"}
    assert [got[i]["status"] for i in range(5, 10)] == ["unmapped", "malformed", "unmapped", "malformed", "ok"]
    assert got[5]["fingerprint"] == chat.fingerprint({"other"}) and len({got[i]["fingerprint"] for i in (1, 2, 3, 4, 5)}) == 5


def test_conversations_with_nulls(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, None, None, "x"), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, 5, "system", "")], "conv_id bigint, turn bigint, role string, text string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_records(chat.records_of_rows(rows))).collect()}
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[2]["n_turns"]) == (4, 0, 1)
    assert chat.digests(chat.format_records(chat.records_of_rows(rows.limit(0)))).count() == 0


def packed(got, docs, capacity):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    want = Counter()
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for d in docs:
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want[(d["doc_id"], len(ids))] += 1
        mine = pieces[(d["doc_id"], len(ids))]
        for r in mine:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for key, times in want.items():
        assert sum(r["length"] for r in pieces[key]) == times * key[1]
    return len(spans)


def test_packing(odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").collect()
    got = packing.pack(odd_docs, capacity=64, max_piece=16).collect()
    n = packed(got, docs, 64)
    assert n * 64 < 1.05 * sum(r["length"] for r in got) + 128
    assert packing.pack(no_docs).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(60, 100))
def test_karmarkar_karp(lengths, capacity):
    window = packing.pack_pool(np.array(lengths), capacity)
    loads = np.bincount(window, lengths)
    assert loads.max() <= capacity and len(window) == len(lengths)
    assert loads.sum() == sum(lengths)


def test_differencing_is_even():
    lengths = np.random.default_rng(0).integers(1, 512, 400)
    window, most = packing.karmarkar_karp(lengths, 50)
    loads = np.bincount(window, lengths, 50)
    assert most == loads.max() and loads.max() - loads.min() < 8


@pytest.fixture(scope="session")
def encoder():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    return e if e.encode("a é 日") else None  # both libraries are loaded


@settings(deadline=None)
@given(text=st.lists(st.sampled_from([*"ab .,'\n\t  éß中😀1<|>", "<|endoftext|>", "\xa0", "\x85", "'s", "don't"]), max_size=40).map("".join))
def test_encoder(encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_roles_of_rows_stay_as_they_are(spark):
    rows = spark.createDataFrame([(1, 0, "human", "q"), (1, 1, "gpt", "a"), (1, 2, "model", "b"), (1, 3, "assistant", "c")], "conv_id bigint, turn int, role string, text string")
    rows = rows.withColumn("rows", F.lit("x")).withColumn("record", F.lit("x")).withColumn("formatted", F.lit("x"))
    formatted = chat.format_records(chat.records_of_rows(rows))
    assert chat.read_turns(formatted.first()["formatted"]) == [("human", "q"), ("gpt", "a"), ("model", "b"), ("assistant", "c")]
    assert chat.digests(formatted).first()["loss_chars"] == 1


def test_very_long_turn(spark):
    long = "<|im_end|> words " * 50_000
    got = chat.format_records(chat.records_of_rows(spark.createDataFrame([(1, 0, "assistant", long)], "conv_id bigint, turn int, role string, text string"))).first()
    assert chat.read_turns(got["formatted"]) == [("assistant", long)]


WORDY = "some words that are all of them different from each other in this text here now and then with more of them to come {}"


def hosts_table(spark, rates):
    """200 documents a host, or as many as it says; a share of each fails."""
    rows = [(h, "short" if i < rate * n else WORDY.format(f"{h} {i}")) for h, (rate, n) in rates.items() for i in range(n)]
    return spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id bigint, text string, source string")


def test_hosts_decide_where_they_differ(spark):
    """Rates like those of real sources, a bad host among them, and a sparse one that shrinkage saves."""
    rates = {f"h{k}": (0.02 + 0.006 * k, 200) for k in range(20)} | {"bad": (0.5, 200), "sparse": (1.0, 2)}
    out = quality_rules.judge(hosts_table(spark, rates), carry=["doc_id", "source"])
    assert {r["source"] for r in out.filter("host_rejected").select("source").distinct().collect()} == {"bad"}
    assert out.filter("NOT base_failed AND NOT kept").count() == 100
    assert quality_rules.keep_good(hosts_table(spark, rates)).filter("source = 'bad'").count() == 0
    alike = quality_rules.judge(hosts_table(spark, {f"h{k}": (0.4 + 0.01 * (k % 3), 200) for k in range(10)}))
    assert alike.filter("host_rejected").count() == 0


@pytest.mark.parametrize("operator", ["shard", "pack", "mix"])
def test_half_the_rows_are_copies_without_id(spark, operator):
    """Hot rows are dealt as evenly as others; their results are those of separate documents."""
    texts = [WORDY.format(i) for i in range(400)] + [WORDY.format("same")] * 400
    docs = spark.createDataFrame([(None if i >= 400 else i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    if operator == "shard":
        got = sharding.shard(docs).collect()
        per = np.bincount([r["shard"] for r in got if r["doc_id"] is None], minlength=8)
        assert len(got) == 800 and sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(8) for i in range(100)] and per.min() > 20
    elif operator == "pack":
        got = packing.pack(docs, capacity=64, max_piece=16, pool_pieces=64).collect()
        packed(got, docs.collect(), 64)
        pools = Counter(r["sequence_id"] >> 24 for r in got)
        assert len(pools) > 20 and max(pools.values()) < 3 * 64
    else:
        got = mixing.curriculum(docs).collect()
        assert len(got) == 800 and len({r["position"] for r in got}) == 800 and all(r["taken"] == r["size"] for r in got)
        assert sorted(map(str, got)) == sorted(map(str, mixing.curriculum(docs.repartition(7)).collect()))
        assert Counter(r["doc_id"] for r in mixing.mix(docs).collect())[None] == 400
