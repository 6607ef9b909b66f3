"""Fourier transforms of long pages, each in many tasks.

n = a * b values are a matrix of a rows and b columns. Tasks transform some of its columns and multiply them by powers of
the n-th root of unity, others then transform some of its rows; between them go blocks of the matrix, a binary value each.
A task's group holds `part` values, or one column or row. Where n has no two factors of at most `whole` (a prime, say),
the transform is a convolution with a chirp (Bluestein), by transforms of a power of two.

Defined cases: places without a row are zeros; a page has up to 2^31 places.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest page, column or row that is transformed at once; values of a group of columns or rows.
WHOLE, PART = 1 << 20, 1 << 18
PLACED = "__id bigint, __i bigint, re double, im double"


def factors(n: int, whole: int = WHOLE) -> tuple[int, int] | None:
    """The factors of n nearest each other, if both are at most `whole`."""
    a = next(a for a in range(math.isqrt(n), 0, -1) if n % a == 0)
    return (a, n // a) if n // a <= whole else None


def _direct(z: DataFrame, shapes: dict[int, tuple[int, int]], part: int) -> DataFrame:
    """PLACED, the transforms of pages (__id) of a * b values; z has re, and im if it is not real."""
    kinds = z.sparkSession.createDataFrame([(i, b, max(1, part // a)) for i, (a, b) in shapes.items()], "__id bigint, __b bigint, __w bigint")
    real = "im" not in z.columns
    z = z.join(F.broadcast(kinds), "__id").withColumn("__k", F.floor(F.col("__i") % F.col("__b") / F.col("__w"))).drop("__b", "__w")  # a row a page

    def columns(key: tuple, t: pa.Table) -> pa.Table:
        page, k = (x.as_py() for x in key)
        a, b = shapes[page]
        width, height = max(1, part // a), max(1, part // b)
        first = k * width
        at = np.arange(first, min(first + width, b))
        m = np.zeros((a, len(at)), complex)
        i = t.column("__i").to_numpy()
        m[i // b, i % b - first] = t.column("re").to_numpy() if real else t.column("re").to_numpy() + 1j * t.column("im").to_numpy()
        m = np.fft.fft(m, axis=0)
        m *= np.exp(-2j * np.pi / (a * b) * (np.arange(a)[:, None] * at))
        blocks = [m[r : r + height].tobytes() for r in range(0, a, height)]
        n = len(blocks)
        return pa.table([pa.array(np.full(n, page)), pa.array(np.arange(n)), pa.array(np.full(n, first)), pa.array(blocks, pa.binary())], ["__id", "__r", "__first", "block"])

    def rows(key: tuple, t: pa.Table) -> pa.Table:
        page, r = (x.as_py() for x in key)
        a, b = shapes[page]
        height = max(1, part // b)
        at = np.arange(r * height, min((r + 1) * height, a))
        m = np.zeros((len(at), b), complex)
        for first, block in zip(t.column("__first").to_pylist(), t.column("block"), strict=True):
            block = np.frombuffer(block.as_buffer(), complex).reshape(len(at), -1)
            m[:, first : first + block.shape[1]] = block
        m = np.fft.fft(m, axis=1).T
        k = (at + a * np.arange(b)[:, None]).reshape(-1)
        return pa.table([pa.array(np.full(len(k), page)), pa.array(k), pa.array(m.real.reshape(-1)), pa.array(m.imag.reshape(-1))], ["__id", "__i", "re", "im"])

    blocks = z.groupBy("__id", "__k").applyInArrow(columns, "__id bigint, __r bigint, __first bigint, block binary")
    return blocks.groupBy("__id", "__r").applyInArrow(rows, PLACED)


def _times(a: tuple[Column, Column], b: tuple[Column, Column]) -> list[Column]:
    return [(a[0] * b[0] - a[1] * b[1]).alias("re"), (a[0] * b[1] + a[1] * b[0]).alias("im")]


def _chirp(n: Column) -> tuple[Column, Column]:
    """exp(-i pi j^2 / n), j = __i."""
    angle = F.col("__i") * F.col("__i") % (2 * n) * (math.pi / n.cast("double"))
    return F.cos(angle), -F.sin(angle)


def transform(z: DataFrame, sizes: dict[int, int], whole: int = WHOLE, part: int = PART) -> DataFrame:
    """PLACED, sum over j of z[j] exp(-2 pi i j k / n) at each place k of each page. z: __id, __i, re, and im if it is not real;
    sizes: n of each page."""
    shapes = {i: factors(n, whole) for i, n in sizes.items()}
    good = {i: s for i, s in shapes.items() if s}
    if len(good) == len(sizes):
        return _direct(z, good, part)
    bad = {i: n for i, n in sizes.items() if i not in good}
    spark = z.sparkSession
    longer = {n: 1 << (2 * n - 2).bit_length() for n in set(bad.values())}
    halves = {m: (1 << (m.bit_length() - 1) // 2, 1 << m.bit_length() // 2) for m in longer.values()}
    lengths = F.broadcast(spark.createDataFrame([(i, n, longer[n]) for i, n in bad.items()], "__id bigint, __n bigint, __m bigint"))  # a row a page
    im = F.col("im") if "im" in z.columns else F.lit(0.0)
    chirp = _chirp(F.col("__n"))
    u = z.join(lengths, "__id").select("__id", "__i", *_times((F.col("re"), im), chirp))
    u = _direct(u, {i: halves[longer[n]] for i, n in bad.items()}, part)
    # of each length the conjugate chirp, at j and -j
    both = lambda n: spark.range(1 - n, n).select(F.lit(n).cast("bigint").alias("__id"), F.col("id").alias("__i"))
    v = reduce(DataFrame.unionByName, [both(n).select("__id", F.pmod(F.col("__i"), F.lit(longer[n])).alias("__i"), _chirp(F.lit(n))[0].alias("re"), (-_chirp(F.lit(n))[1]).alias("im")) for n in longer])
    v = _direct(v, {n: halves[m] for n, m in longer.items()}, part).select(F.col("__id").alias("__n"), F.col("__i").alias("__at"), F.col("re").alias("vre"), F.col("im").alias("vim"))
    u = u.join(lengths, "__id")
    w = u.join(v, (u["__n"] == v["__n"]) & (u["__i"] == v["__at"])).select("__id", "__i", *_times((F.col("re"), F.col("im")), (F.col("vre"), F.col("vim"))))
    # back: the conjugate of the transform of the conjugate
    w = _direct(w.withColumn("im", -F.col("im")), {i: halves[longer[n]] for i, n in bad.items()}, part).join(lengths, "__id").filter("__i < __n")
    w = w.select("__id", "__i", *_times((F.col("re") / F.col("__m"), -F.col("im") / F.col("__m")), chirp))
    return w.unionByName(_direct(z, good, part)) if good else w
