"""Matrix products in long form, and decompositions page by page."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.frame import Paged
from quire.operators.grouped import per_page


def long_form(df: DataFrame, row: str, columns: Sequence[str], names: tuple[str, str, str] = ("i", "j", "v")) -> DataFrame:
    """One row per cell: i is the row key, j the column name."""
    return df.select(row, *[F.col(c).cast("double") for c in columns]).unpivot([row], list(columns), names[1], names[2]).withColumnRenamed(row, names[0])


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of long-form matrices (i, j, v): a join on the inner index and a sum."""
    right = b.select(F.col("i").alias("__k"), F.col("j").alias("__j"), F.col("v").alias("__v"))
    return a.join(right, F.col("j") == F.col("__k")).groupBy("i", F.col("__j").alias("j")).agg(F.sum(F.col("v") * F.col("__v")).alias("v"))


def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    right = b.select("i", "j", (F.col("v") * sign).alias("v"))
    return a.select("i", "j", "v").unionByName(right).groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _page_matrix(p: Paged, columns: Sequence[str], f, schema: str) -> DataFrame:
    return per_page(p, columns, lambda c: f(np.stack([c[x].astype(float) for x in columns], 1)), schema)


def invert(p: Paged, columns: Sequence[str]) -> DataFrame:
    """Inverse of the square matrix of each page: Row and the columns."""
    return _page_matrix(p, columns, lambda m: {"Row": np.arange(len(m))} | dict(zip(columns, np.linalg.inv(m).T, strict=True)), "Row bigint, " + ", ".join(f"`{c}` double" for c in columns))


def determinant(p: Paged, columns: Sequence[str]) -> DataFrame:
    return _page_matrix(p, columns, lambda m: {"Determinant": float(np.linalg.det(m))}, "Determinant double")


def _invert_singular(s: np.ndarray, min_ratio: float, largest: int | None, tikhonov: float) -> np.ndarray:
    keep = s > min_ratio * (s[0] if len(s) else 1)
    if largest is not None:
        keep &= np.arange(len(s)) < largest
    return np.where(keep, s / (s**2 + tikhonov**2) if tikhonov else 1 / np.where(s > 0, s, 1), 0)


def pseudo_inverse(p: Paged, columns: Sequence[str], min_ratio: float = 1e-12, largest: int | None = None, tikhonov: float = 0.0, weight: str | None = None) -> DataFrame:
    """Moore-Penrose inverse by singular values above min_ratio of the largest: OldColumnName and Inverse, an array with
    one entry per row of the page."""

    def f(c):
        m = np.stack([c[x].astype(float) for x in columns], 1)
        w = c[weight].astype(float) if weight else np.ones(len(m))
        u, s, vt = np.linalg.svd(m * w[:, None], full_matrices=False)
        inverse = (vt.T * _invert_singular(s, min_ratio, largest, tikhonov)) @ u.T * w
        return {"OldColumnName": list(columns), "Inverse": [row.tolist() for row in inverse]}

    return per_page(p, [*columns, *([weight] if weight else [])], f, "OldColumnName string, Inverse array<double>")


def complex_pseudo_inverse(p: Paged, real: Sequence[str], imag: Sequence[str], min_ratio: float = 1e-12) -> DataFrame:
    def f(c):
        m = np.stack([c[a].astype(float) + 1j * c[b].astype(float) for a, b in zip(real, imag, strict=True)], 1)
        u, s, vt = np.linalg.svd(m, full_matrices=False)
        z = (vt.conj().T * _invert_singular(s, min_ratio, None, 0.0)) @ u.conj().T
        return {"OldColumnName": list(real), "Real": [r.real.tolist() for r in z], "Imag": [r.imag.tolist() for r in z]}

    return per_page(p, [*real, *imag], f, "OldColumnName string, Real array<double>, Imag array<double>")


def singular_values(p: Paged, columns: Sequence[str]) -> DataFrame:
    def f(m):
        s = np.linalg.svd(m, compute_uv=False)
        return {"Index": np.arange(len(s)), "SingularValue": s}

    return _page_matrix(p, columns, f, "Index int, SingularValue double")


def gram(df: DataFrame, array: str, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, covariance and count of an array column: every partition sums its products in Arrow batches; the sums,
    dim^2 numbers a partition, are added by Spark."""

    def parts(it):
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in it:
            m = np.stack(pdf[array].to_numpy()) if len(pdf) else np.zeros((0, dim))
            n, s, g = n + len(m), s + m.sum(0), g + m.T @ m
        yield pd.DataFrame({"k": np.arange(dim * dim + dim + 1), "v": np.r_[g.ravel(), s, n]})

    got = df.select(F.col(array).cast("array<double>").alias(array)).mapInPandas(parts, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()
    n = int(got[-1])
    mean = got[dim * dim : -1] / max(n, 1)
    return mean, got[: dim * dim].reshape(dim, dim) / max(n, 1) - np.outer(mean, mean), n


def principal_components(df: DataFrame, array: str, dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances and directions (rows), each direction's largest entry positive."""
    _, cov, _ = gram(df, array, dim)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values)[:count]
    v = vectors[:, top].T
    return values[top], v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def independent_components(p: Paged, columns: Sequence[str], count: int, rounds: int = 200) -> DataFrame:
    """FastICA with the hyperbolic tangent: Row and Source1...; sources have unit variance."""

    def f(m):
        m = m - m.mean(0)
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        z = u[:, :count] * np.sqrt(len(m))
        w = np.linalg.qr(np.random.default_rng(0).normal(size=(count, count)))[0]
        for _ in range(rounds):
            y = np.tanh(z @ w.T)
            after = (y.T @ z) / len(z) - np.diag((1 - y**2).mean(0)) @ w
            a, _, b = np.linalg.svd(after)
            after = a @ b
            done = np.abs(np.abs((after * w).sum(1)) - 1).max() < 1e-10
            w = after
            if done:
                break
        return {"Row": np.arange(len(m))} | {f"Source{k + 1}": (z @ w.T)[:, k] for k in range(count)}

    return _page_matrix(p, columns, f, "Row bigint, " + ", ".join(f"Source{k + 1} double" for k in range(count)))


def response_derivative(p: Paged, columns: Sequence[str]) -> DataFrame:
    """Differences of each row to the next of a response matrix: Row and `d<column>`."""
    o = p.over()
    q = p.numbered("Row").rows
    out = q.select(*p.page, "Row", *[(F.lead(F.col(c).cast("double")).over(o) - F.col(c).cast("double")).alias(f"d{c}") for c in columns])
    return out.filter(F.col(f"d{columns[0]}").isNotNull())
