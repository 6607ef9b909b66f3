"""Operator 12, ranked lexical search with variable blocks of postings and their maxima.

A first pass over the texts keeps, of each document, its number of terms and how often it holds each term that a query
asks for; corpus counts come from these rows. Documents are then dealt to shards by the place they were read at, so no
term, source or copied text meets in one task, and each shard is searched by a task of its own: its postings are put in
lists by term, documents in ascending doc_id, and each list is cut into blocks. Dynamic programming chooses the cuts: a
block costs the sum of its maximum less each of its impacts, plus a fee, and the cuts of least cost are found exactly
within runs of 1,024 postings (the fee of a list is twelve standard deviations of its impacts, which gives blocks of some
thirty postings, short ones where high impacts stand).

A query walks the shard in document order. Between two ends of blocks of any of its lists, one block of each list is
current, and the sum of their weighted maxima bounds every document there. Stretches whose bound is below the k-th best
score so far are skipped unread; in the others, a document is a candidate if the blocks of just the lists that hold it
reach that score, and candidates are scored in full. The walk goes in strides of many stretches at once, after the few
of highest bound, which raise the k-th best score early. Bounds that equal it are followed, so ties are exact. Shards
return k documents a query, and the best k of these are the result.

Queries are dealt to blocks of about 2**18 terms, and each block is searched by one pass over all documents; the driver
holds the terms of one block, never those of documents.

Defined cases: a null or empty text has no terms and is no document of the counts; queries that are null, empty or of
words that no document holds have no rows; repeated rows and rows of one id are ranked each, null ids after all others;
repeated queries are answered each; texts are read whole, however long; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, text_of

#: ASCII letters and digits, lower-cased, and all bytes of other characters make up terms; the rest parts them.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))

#: Postings of a shard, and shards at least, so that small inputs still use several cores.
SHARD_POSTINGS, LEAST_SHARDS = 1 << 21, 16
BLOCK_TERMS = 1 << 18
RUN, LONGEST, FEE = 1024, 128, 12.0
FIRST, STRIDE = 64, 1024


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_TERM_BYTES).split()


def block_ends(impacts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where blocks end, for lists of impacts that begin at `starts`: True at the last posting of each block."""
    n = len(impacts)
    sizes = np.diff(np.r_[starts, n])
    of = np.repeat(np.arange(len(starts)), sizes)
    x = impacts.astype(np.float64)
    mean = np.add.reduceat(x, starts) / sizes
    fee = FEE * np.sqrt(np.add.reduceat((x - mean[of]) ** 2, starts) / sizes) + 1e-9
    run = np.concatenate([np.arange(a, a + s, RUN) for a, s in zip(starts, sizes, strict=True)])
    length = np.minimum(np.r_[run[1:], n], (starts + sizes)[of[run]]) - run
    ends = np.zeros(n, bool)
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(run), 256):  # runs of like length together
        some = order[at : at + 256]
        first, size, cost = run[some], length[some], fee[of[run[some]]]
        m, most = len(some), int(size.max())
        width = min(LONGEST, most)
        high = np.zeros((m, width))  # the largest of the last 1, 2, ... impacts
        best = np.full((m, most + 1), np.inf)
        best[:, 0] = 0
        back = np.zeros((m, most + 1), np.int64)
        long = np.arange(1, width + 1)
        for i in range(1, most + 1):
            value = x[np.minimum(first + i - 1, n - 1)]
            high[:, 1:] = high[:, :-1]
            high[:, 0] = 0
            np.maximum(high, value[:, None], out=high)
            w = min(i, width)
            total = best[:, i - w : i][:, ::-1] + high[:, :w] * long[:w]
            back[:, i] = total.argmin(1) + 1
            best[:, i] = total[np.arange(m), back[:, i] - 1] + cost
        at_end, rows = size.copy(), np.arange(m)
        while len(rows):
            ends[first[rows] + at_end[rows] - 1] = True
            at_end[rows] -= back[rows, at_end[rows]]
            rows = rows[at_end[rows] > 0]
    return ends


class Shard:
    """Postings of a shard by term, with the ends and maxima of their blocks."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        """Postings in order of term and document."""
        self.docs = docs
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])[: len(term)]
        ends = np.flatnonzero(block_ends(impact, first)) if len(term) else np.zeros(0, np.int64)
        begins = np.r_[0, ends[:-1] + 1][: len(ends)]
        highest = np.maximum.reduceat(impact, begins) if len(ends) else np.zeros(0, np.int64)
        last, block = np.r_[first[1:], len(term)], np.searchsorted(begins, np.r_[first, len(term)])
        self.lists = {int(term[a]): (doc[a:z], impact[a:z], doc[ends[p:q]], highest[p:q]) for a, z, p, q in zip(first, last, block[:-1], block[1:], strict=True)}

    def search(self, terms: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents for terms with weights, their scores, and how many documents were scored."""
        lists = [(w, *self.lists[t]) for t, w in terms if w > 0 and t in self.lists]
        best, scores, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not lists:
            return best, scores, scored
        ends = np.unique(np.concatenate([e for _, _, _, e, _ in lists]))
        current = lambda w, e, m, at: np.r_[w * m, 0][np.searchsorted(e, ends[at])]  # noqa: E731  a list's bound in stretches
        bound = np.zeros(len(ends), np.int64)
        for w, _, _, e, m in lists:
            bound += current(w, e, m, slice(None))
        before = np.r_[-1, ends[:-1]]
        reach, score = np.zeros(self.docs, np.int64), np.zeros(self.docs, np.int64)
        todo = np.ones(len(ends), bool)

        def visit(some: np.ndarray) -> None:
            nonlocal best, scores, scored
            least, todo[some], parts = (scores[k - 1] if len(scores) >= k else 1), False, []
            for w, doc, impact, e, m in lists:
                a, z = np.searchsorted(doc, before[some], "right"), np.searchsorted(doc, ends[some], "right")
                n = z - a
                at = np.repeat(z - np.cumsum(n), n) + np.arange(n.sum())
                found = doc[at]
                reach[found] += np.repeat(current(w, e, m, some), n)
                parts.append((w, found, impact[at]))
            seen = np.concatenate([f for _, f, _ in parts])
            for w, found, impact in parts:
                fit = reach[found] >= least
                score[found[fit]] += w * impact[fit]
            docs = np.unique(seen[reach[seen] >= least])
            best, scores, scored = np.r_[best, docs], np.r_[scores, score[docs]], scored + len(docs)
            reach[seen] = score[seen] = 0
            order = np.lexsort((best, -scores))
            order = order[scores[order] > 0][:k]
            best, scores = best[order], scores[order]

        visit(np.sort(np.argsort(-bound, kind="stable")[:FIRST]))
        at = 0
        while at < len(ends):
            near = at + np.flatnonzero(todo[at:] & (bound[at:] >= (scores[k - 1] if len(scores) >= k else 1)))[:STRIDE]
            if not len(near):
                break
            visit(near)
            at = near[-1] + 1
        return best, scores, scored


def _occurrences(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Of each document with terms: its id, number of terms, place, and the asked terms with their occurrences."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, place = terms.get, (TaskContext.get().partitionId() * 0x9E3779B1) & 0x7FFFFFFF
        for batch in it:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                row, n, held, times, size = [], [], [], [], [0]
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = terms_of(text)
                    if words:
                        found = Counter(map(get, words))
                        found.pop(None, None)
                        row.append(i)
                        n.append(len(words))
                        held += found.keys()
                        times += found.values()
                        size.append(len(held))
                ends = pa.array(size, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (held, times)]
                places = pa.array(np.arange(place, place + len(row)), pa.int64())
                place += len(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int64()), places, *lists], ["doc_id", "n", "place", "terms", "times"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(batches, "doc_id bigint, n bigint, place bigint, terms array<int>, times array<int>")


def _items(items: DataFrame) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([sorted(set(terms_of(t))) for t in b.column(2).to_pylist()], pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", text_of().alias("text"))
    kind = numbered.schema["item_id"].dataType.simpleString()
    return materialize(numbered.mapInArrow(batches, f"item bigint, item_id {kind}, terms array<binary>"), "items")


def _search_block(docs: DataFrame, queries: list, k: int) -> DataFrame:
    """item, doc_id and score: k rows a shard and query at most."""
    terms = {t: i for i, t in enumerate(dict.fromkeys(bytes(t) for q in queries for t in q["terms"]))}
    found = materialize(_occurrences(docs, terms), "occurrences")
    corpus = found.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = {r["t"]: r["n"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_docs, n_terms = corpus["docs"], corpus["terms"]
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in held.items()}
    asked = [(q["item"], [(i, weight[i]) for t in q["terms"] if (i := terms[bytes(t)]) in weight]) for q in queries]
    shards = max(LEAST_SHARDS, math.ceil(sum(held.values()) / SHARD_POSTINGS))

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("place", "ascending")])  # nulls are last
        size = np.diff(np.asarray(t.column("terms").combine_chunks().offsets))
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        term, times, doc = flat("terms"), flat("times"), np.repeat(np.arange(len(t)), size)
        m = 10 + 90 * t.column("n").to_numpy() * n_docs // n_terms
        impact = 1_000_000_000 * times // (1000 * times + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        shard = Shard(term[order], doc[order], impact[order], len(t))
        item, best, score = [], [], []
        for number, q in asked:
            docs, scores, _ = shard.search(q, k)
            item.append(np.full(len(docs), number, np.int64))
            best.append(docs)
            score.append(scores)
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"item": joined(item), "doc_id": t.column("doc_id").take(pa.array(joined(best), pa.int64())), "score": joined(score)})

    some = found.filter(F.size("terms") > 0).withColumn("shard", F.pmod("place", F.lit(shards)))
    return some.groupBy("shard").applyInArrow(search, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents (doc_id, text) for each row of items (item_id, text)."""
    items = _items(items)
    blocks = max(1, math.ceil((items.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    number = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, (_search_block(docs, items.filter(number == b).collect(), k) for b in range(blocks)))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
