"""Operator 1, toxicity by a factorization machine over hashed terms.

A document's terms are the pieces between white space, lower-cased, without the punctuation around them, and the first
4 to 6 letters of each, which stand for its inflected forms. A feature is the 32-bit hash of a term and a level: the
document has the term at least 1, 2, 3 or 5 times. score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>): the
factors v learn that two features together say more, or less, than each alone.

Fitting uses at most max_rows labelled documents (a documented bound) and, of their features, the max_features that
depend most on the label. Features are counted and chosen on the executors: what comes to the driver to fit on is at
most max_rows lists of at most max_features small numbers, however long the texts. The model is of bounded size and goes
to the workers with the function. Scoring reads every whole text once and shuffles nothing.

Defined cases: null and empty texts have no features and get the score of the bias; without labels of both kinds
nothing tells documents apart and the score is 0, or 0.5 if all labels are 1; repeated rows are scored each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm.common import materialize, text_of
from quire.llm.labelled import labelled_sample

TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¿¡…–—"
#: Pieces of text a task remembers the features of.
CACHE = 150_000
STEMS = (4, 5, 6)
LEVELS = (1, 2, 3, 5)


def term_hashes(piece: str) -> list[int]:
    """The hash of the term in a piece of text, and those of its stems, marked as such."""
    term = piece.lower().strip(TRIM)
    stems = [term[:n] + "-" for n in STEMS if len(term) > n]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in (term, *stems)]


def features(text: str) -> list[int]:
    """hash * 4 + index of the level, sorted."""
    counts: Counter[int] = Counter()
    for piece, n in Counter(text.split()).items():
        for h in term_hashes(piece):
            counts[h] += n
    return sorted(h * len(LEVELS) + i for h, n in counts.items() for i, least in enumerate(LEVELS) if n >= least)


def _ragged_sum(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs that end at `ends`."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[ends] - total[np.r_[0, ends[:-1]]]


class FactorizationMachine:
    def __init__(self, keys: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        """keys: the sorted features that w and v have rows for."""
        terms = np.unique(keys // len(LEVELS))
        self.term = {int(h): i for i, h in enumerate(terms)}
        self.row = np.full((len(terms), len(LEVELS)), -1, np.int64)  # of w and v, by term and level
        self.row[np.searchsorted(terms, keys // len(LEVELS)), keys % len(LEVELS)] = np.arange(len(keys))
        self.w0, self.w, self.v = w0, w, v

    def margins(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """rows: feature rows of all documents, one after another; ends: where each document ends."""
        if not len(ends):
            return np.zeros(0)
        v = self.v[rows].astype(np.float64)
        s, q, w = _ragged_sum(v, ends), _ragged_sum((v * v).sum(1), ends), _ragged_sum(self.w[rows].astype(np.float64), ends)
        return self.w0 + w + 0.5 * ((s * s).sum(1) - q)

    def scores(self, texts: list[str], cache: dict[str, tuple[int, ...]], block: int = 256) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._scores(texts[at : at + block], cache) for at in range(0, len(texts), block))])

    def _scores(self, texts: list[str], cache: dict[str, tuple[int, ...]]) -> np.ndarray:
        get, known, n_terms = cache.get, self.term, max(1, len(self.term))
        keys, times = [], []
        for doc, text in enumerate(texts):
            for p, n in Counter(text.split()).items():
                r = get(p)
                if r is None:
                    r = tuple(known[h] for h in term_hashes(p) if h in known)
                    if len(cache) < CACHE:
                        cache[p] = r
                for t in r:
                    keys.append(doc * n_terms + t)
                    times.append(n)
        key, at = np.unique(np.array(keys, np.int64), return_inverse=True)
        count = np.bincount(at, np.array(times, float), len(key)) if len(key) else np.zeros(0)
        rows = np.where(count[:, None] >= np.array(LEVELS), self.row[key % n_terms], -1) if len(key) else np.zeros((0, len(LEVELS)), np.int64)
        has = rows >= 0
        ends = np.cumsum(np.bincount(key // n_terms, has.sum(1), len(texts))).astype(np.int64) if len(key) else np.zeros(len(texts), np.int64)
        z = self.margins(rows[has], ends)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _most_telling(docs: list[np.ndarray], y: np.ndarray, max_features: int, min_docs: int) -> np.ndarray:
    """The features found in min_docs documents at least with the largest chi-square of presence and label."""
    keys, n = np.unique(np.concatenate(docs), return_counts=True)
    keys, n = keys[n >= min_docs], n[n >= min_docs]
    ones, total, p = np.zeros(len(keys)), len(docs), y.mean()
    for d, label in zip(docs, y, strict=True):
        if label:
            ones[np.searchsorted(keys, d[np.isin(d, keys, assume_unique=True)])] += label
    chi = (ones - n * p) ** 2 / np.maximum(n * p * (1 - p) * (1 - n / total), 1e-9)
    best = np.lexsort((keys, -chi))[:max_features]
    return np.sort(keys[best[chi[best] > 0]])


def fit(docs: list[np.ndarray], y: np.ndarray, max_features: int = 1 << 11, min_docs: int = 3, **how) -> FactorizationMachine:
    """docs: all features of each document."""
    if not len(y) or y.min() == y.max():
        return fit_chosen(np.zeros(0, np.int64), [], y, **how)
    keys = _most_telling(docs, y, max_features, min_docs)
    return fit_chosen(keys, [np.flatnonzero(np.isin(keys, d, assume_unique=True)) for d in docs], y, **how)


def fit_chosen(keys: np.ndarray, where: list[np.ndarray], y: np.ndarray, factors: int = 6, epochs: int = 50, rate: float = 0.1, l2: float = 3e-4, dropout: float = 0.3, heavy: float = 1.0, batch: int = 64, seed: int = 5) -> FactorizationMachine:
    """keys: the chosen features, sorted; where: which of them each document has. AdaGrad on the log loss. Each time, a document shows only some of its features: a stem has to carry weight
    without the words it was seen with, or a form not seen in fitting would go unnoticed."""
    prior = float(y.mean()) if len(y) else 0.0
    w0 = math.log(max(prior, 1e-9) / max(1 - prior, 1e-9))
    if not len(y) or prior in (0.0, 1.0):
        w0 = min(w0, 0.0)
        return FactorizationMachine(np.zeros(0, np.int64), w0, np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    heavier = max(1.0, (1 - prior) / prior) ** heavy  # at 1 both labels weigh the same
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(keys)), rng.normal(0, 0.01, (len(keys), factors))
    gw, gv, g0 = np.full(len(keys), 1e-6), np.full(v.shape, 1e-6), 1e-6
    model = FactorizationMachine(keys, w0, w, v)
    for _ in range(epochs):
        shuffled = rng.permutation(len(where))
        for at in range(0, len(where), batch):
            some = shuffled[at : at + batch]
            shown = [where[i][rng.random(len(where[i])) >= dropout] for i in some]
            rows, sizes = np.concatenate(shown), np.array([len(x) for x in shown])
            ends, doc = np.cumsum(sizes), np.repeat(np.arange(len(some)), sizes)
            p = 1 / (1 + np.exp(-np.clip(model.margins(rows, ends), -40, 40)))
            err = (p - y[some]) * np.where(y[some] > 0, heavier, 1.0)
            s = _ragged_sum(v[rows], ends)
            used, at_row = np.unique(rows, return_inverse=True)
            dw = np.bincount(at_row, err[doc], len(used)) + l2 * len(some) * w[used]
            inner = err[doc, None] * (s[doc] - v[rows])
            dv = np.stack([np.bincount(at_row, inner[:, f], len(used)) for f in range(factors)], 1) + l2 * len(some) * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += err.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate / 4 * dv / np.sqrt(gv[used])
            model.w0 -= rate * err.sum() / math.sqrt(g0)
    shown = 1 - dropout  # all features are shown from now on
    return FactorizationMachine(keys, model.w0, (w * shown).astype(np.float32), (v * shown).astype(np.float32))


def chosen_features(sample: DataFrame, max_features: int, min_docs: int = 3) -> np.ndarray:
    """The features, sorted, found in min_docs documents at least with the largest chi-square of presence and label, as
    counted over sample (y, terms). Only they come to the driver."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            terms, y = b.column(1), b.column(0).to_numpy().astype(np.int64)
            key, at = np.unique(terms.flatten().to_numpy(), return_inverse=True)
            label = np.repeat(y, pa.compute.list_value_length(terms).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at, minlength=len(key))), pa.array(np.bincount(at, label, len(key)).astype(np.int64))], ["key", "n", "ones"])

    sums = sample.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("p")).first()
    total, p = sums["n"], sums["p"]
    if not total or p in (0.0, 1.0):
        return np.zeros(0, np.int64)
    counts = sample.select("y", "terms").mapInArrow(batches, "key bigint, n bigint, ones bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    n = F.col("n")
    chi = F.pow(F.col("ones") - n * p, 2) / F.greatest(n * p * (1 - p) * (1 - n / total), F.lit(1e-9))
    best = counts.filter(n >= min_docs).select("key", chi.alias("chi")).filter("chi > 0").orderBy(F.desc("chi"), "key").limit(max_features)
    return np.sort(best.select("key").toArrow().column("key").to_numpy())


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, max_rows: int = 8_000, max_features: int = 1 << 11) -> FactorizationMachine:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            terms = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(terms, pa.list_(pa.int64()))], ["doc_id", "y", "terms"])

    def numbers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            where = [np.flatnonzero(np.isin(keys, x.values.to_numpy(), assume_unique=True)).astype(np.int32) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where, pa.list_(pa.int32()))], ["doc_id", "y", "has"])

    sample = labelled_sample(docs, labels, "toxic", allowed, max_rows)
    sample = sample.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "y").mapInArrow(batches, "doc_id bigint, y int, terms array<bigint>")
    sample = materialize(sample, "toxic")
    keys = chosen_features(sample, max_features)
    rows = sample.mapInArrow(numbers, "doc_id bigint, y int, has array<int>").toArrow().sort_by([("doc_id", "ascending")])
    return fit_chosen(keys, [x.values.to_numpy() for x in rows.column("has").combine_chunks()], rows.column("y").to_numpy().astype(float))


def _in_batches(docs: DataFrame, work, more: list[StructField]) -> DataFrame:
    """work on docs' batches, whatever the names of docs' columns, with more columns at their end."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(work, StructType([*plain.schema.fields, *more])).toDF(*docs.columns, *[f.name for f in more])


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", out: str = "__score") -> DataFrame:
    """docs with a last column `out`."""
    at = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in it:
            got = model.scores(["" if t is None else t for t in b.column(at).to_pylist()], cache)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, out])

    return _in_batches(docs, batches, [StructField(out, DoubleType())])


def keep_below(docs: DataFrame, model: FactorizationMachine, limit: float, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that are scored below limit."""
    at = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in it:
            yield b.filter(pa.array(model.scores(["" if t is None else t for t in b.column(at).to_pylist()], cache) < limit))

    return _in_batches(docs, batches, [])


def score_ids(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id and score."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist(), cache), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(batches, "doc_id bigint, score double")
