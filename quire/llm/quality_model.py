"""Operator 2, a quality classifier: kernel ridge scores by random Fourier features, calibrated by isotonic regression.

1. One pass over the whole texts turns each into 20 statistics (lengths, shares of kinds of bytes, repetition, ...).
2. Statistics are standardised, and mapped by cos(x W + b), with W drawn from a normal law, to features whose inner
   products approximate a Gaussian kernel.
3. Each partition of the labelled rows sums its part of the normal equations; the partial sums are added in two rounds,
   so no task or driver ever holds more than a few of them, and the ridge is solved once.
4. Rows set aside by a hash of doc_id calibrate: pool-adjacent-violators over at most `bins` weighted bins of the score.

Learning uses every labelled row allowed. Defined cases: null and empty texts have zero statistics and are scored like
others; without labels every score is 0.5, with one kind only the share of label 1; repeated rows are scored each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, text_of

STATISTICS = 20
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line feed, 6 stop, 7 symbol, 8 not ASCII
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 1, 2, 3
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 4, 5
for _c in ".,;:!?'\"()-":
    _KIND[ord(_c)] = 6
for _c in "#*$%&|<>{}[]\\/@^_~`=+":
    _KIND[ord(_c)] = 7
_KIND[128:] = 8


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * STATISTICS
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, by_byte, 9)
    words = text.split()
    m = len(words) or 1
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = len(lines) or 1
    shares = by_byte[by_byte > 0] / n
    ends = sum(c for w, c in counts.items() if w[-1] in ".!?")
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    odd = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?")
    bare = sum(c for w, c in counts.items() if not w[0].isalnum() and len(w) < 3)
    return [
        math.log1p(len(words)), math.log1p(n), n / m, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / m, kinds[6] / m, kinds[7] / m,
        kinds[8] / n, math.log1p(len(counts)) / math.log1p(m), max(counts.values(), default=0) / m, 1 - len(set(lines)) / k, math.log1p(m / k),
        float(-(shares * np.log(shares)).sum()), ends / m, short / m, odd / m, bare / m,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b), z, np.ones(len(z))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values) if len(self.knots) else np.full(len(x), 0.5)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: x rising and the non-decreasing values there."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight, strict=True):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    return np.array([e for b in blocks for e in b[2:]]), np.array([b[0] for b in blocks for _ in (0, 1)])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each whole text; nothing is shuffled."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(batches, "doc_id bigint, x array<double>")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _sums(parts: DataFrame, rounds: tuple[int, ...] = (16, 1)) -> np.ndarray | None:
    """The sum of the arrays in column s of all rows, added by fewer tasks each round."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            for x in b.column(0).to_pylist():
                x = np.frombuffer(x, np.float64)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    for n in rounds:
        parts = parts.repartition(n).mapInArrow(add, "s binary")
    rows = parts.collect()  # one row
    return np.frombuffer(rows[0]["s"], np.float64) if rows else None


def fit(described: DataFrame, labels: DataFrame, allowed: Column, features: int = 192, ridge: float = 1e-3, bins: int = 512, seed: int = 11) -> Model:
    """described: doc_id and x, written already, as it is read three times."""
    y = labels.filter(F.col("quality").isNotNull() & allowed).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    train = materialize(described.join(y, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("set_aside")), "quality")
    at = range(STATISTICS)
    moments = train.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in at), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in at)).first()
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / math.sqrt(STATISTICS), (STATISTICS, features)), rng.uniform(0, 2 * math.pi, features)
    mean = np.array([moments[f"m{i}"] or 0.0 for i in at])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in at])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), w, b, np.zeros(features + STATISTICS + 1), np.zeros(0), np.zeros(0))
    if not moments["n"]:
        return model
    if moments["y"] in (0.0, 1.0):
        model.knots, model.values = np.zeros(1), np.array([moments["y"]])
        return model
    size = len(model.beta)

    def normal_equations(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size + size)
        for batch in it:
            z, t = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy()
            total += np.r_[(z.T @ z).ravel(), z.T @ t]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    s = _sums(train.filter(~F.col("set_aside")).select("x", "y").mapInArrow(normal_equations, "s binary"))
    if s is not None:
        a = s[: size * size].reshape(size, size)
        model.beta = np.linalg.solve(a + ridge * max(a[-1, -1], 1.0) / features * np.eye(size), s[size * size :])

    def binned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(bins), np.zeros(bins)
        for batch in it:
            at = np.clip((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * bins, 0, bins - 1).astype(int)
            n += np.bincount(at, minlength=bins)
            ones += np.bincount(at, batch.column(1).to_numpy(), bins)
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[n, ones].tobytes()], pa.binary())], ["s"])

    s = _sums(train.select("x", "y", "set_aside").filter("set_aside").select("x", "y").mapInArrow(binned, "s binary"))
    n, ones = (s[:bins], s[bins:]) if s is not None else (np.zeros(bins), np.zeros(bins))
    has = n > 0
    centre = (np.arange(bins) + 0.5) / bins * 2 - 0.5
    if has.any():
        # half a document of each kind keeps scores off 0 and 1
        model.knots, model.values = isotonic(centre[has], ones[has] / n[has], n[has])
        model.values = np.clip(model.values, 0.5 / n.sum(), 1 - 0.5 / n.sum())
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(described: DataFrame, model: Model) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = model.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return described.select("doc_id", "x").mapInArrow(batches, "doc_id bigint, score double")
