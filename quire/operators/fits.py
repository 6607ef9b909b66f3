"""Least-squares fits, page by page."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.frame import Paged
from quire.operators.grouped import per_page


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: np.ndarray, tolerance: float = 1e-12, most: int = 5000) -> np.ndarray:
    """Nelder-Mead descent."""
    n = len(start)
    points = np.array([start, *[start + np.eye(n)[i] * step[i] for i in range(n)]])
    values = np.array([f(x) for x in points])
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + 1e-30):
            break
        centre, worst = points[:-1].mean(0), points[-1]
        trial = centre + (centre - worst)
        v = f(trial)
        if v < values[0]:
            far = centre + 2 * (centre - worst)
            fv = f(far)
            points[-1], values[-1] = (far, fv) if fv < v else (trial, v)
        elif v < values[-2]:
            points[-1], values[-1] = trial, v
        else:
            near = centre + 0.5 * (worst - centre)
            nv = f(near)
            if nv < values[-1]:
                points[-1], values[-1] = near, nv
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(x) for x in points[1:]]
    return points[np.argmin(values)]


def _basis(x: np.ndarray, orders: Sequence[int], chebyshev: bool) -> np.ndarray:
    if chebyshev:
        lo, hi = x.min(), x.max()
        u = (2 * x - lo - hi) / ((hi - lo) or 1.0)
        return np.stack([np.cos(k * np.arccos(np.clip(u, -1, 1))) for k in orders], 1)
    return np.stack([x**k for k in orders], 1)


def _basis_columns(x: Column, orders: Sequence[int], chebyshev: bool) -> list[Column]:
    if not chebyshev:
        return [F.pow(x, F.lit(float(k))) for k in orders]
    inner = F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))
    return [F.cos(k * F.acos(inner)) for k in orders]


def polynomial(p: Paged, x: str, ys: Sequence[str], orders: Sequence[int], sigma: str | None = None, offset: float = 0.0, factor: float = 1.0, chebyshev: bool = False) -> DataFrame:
    """One row per page and dependent column: Dependent, Coefficients, Sigmas, ReducedChiSquared, RmsResidual, Terms; with
    Slope and Intercept where the orders hold them. Fits in (x - offset) / factor.

    The normal equations' sums are aggregated by Spark, so a page may be of any length; what is solved in numpy is one
    small system a page. Powers are of x over its largest magnitude in the page, Chebyshev polynomials of x mapped to -1
    to 1, so sums are of one size.
    """
    page, orders = list(p.page), list(orders)
    q = p.rows.select(*page, ((F.col(x).cast("double") - offset) / factor).alias("__x"), *[F.col(y).cast("double").alias(f"__y{i}") for i, y in enumerate(ys)], (1 / F.col(sigma).cast("double") if sigma else F.lit(1.0)).alias("__w"))
    ends = q.groupBy(*page).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))  # one row a page
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(page)], F.lit(True))
    ends = ends.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(page)], "__lo", "__hi")
    q = q.join(ends, same).drop(*[f"__p{i}" for i in range(len(page))])
    lo, hi = F.col("__lo"), F.col("__hi")
    scale = F.when(hi > lo, (hi - lo) / 2).otherwise(1.0) if chebyshev else F.coalesce(F.nullif(F.greatest(F.abs(lo), F.abs(hi)), F.lit(0.0)), F.lit(1.0))
    q = q.withColumn("__u", (F.col("__x") - (lo + hi) / 2) / scale if chebyshev else F.col("__x") / scale).withColumn("__scale", scale)
    k, w2 = len(orders), F.col("__w") * F.col("__w")
    q = q.withColumns({f"__b{i}": b for i, b in enumerate(_basis_columns(F.col("__u"), orders, chebyshev))})
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(w2 * F.col(f"__b{i}") * F.col(f"__b{j}")).alias(f"m{i}_{j}") for i, j in pairs]
    sums += [F.sum(w2 * F.col(f"__b{i}") * F.col(f"__y{y}")).alias(f"v{y}_{i}") for y in range(len(ys)) for i in range(k)]
    sums += [F.sum(w2 * F.col(f"__y{y}") * F.col(f"__y{y}")).alias(f"s{y}") for y in range(len(ys))]
    if sigma:  # residuals count alike, whatever their weight
        sums += [F.sum(F.col(f"__b{i}") * F.col(f"__b{j}")).alias(f"n{i}_{j}") for i, j in pairs]
        sums += [F.sum(F.col(f"__b{i}") * F.col(f"__y{y}")).alias(f"u{y}_{i}") for y in range(len(ys)) for i in range(k)] + [F.sum(F.col(f"__y{y}") * F.col(f"__y{y}")).alias(f"t{y}") for y in range(len(ys))]
    done = q.groupBy(*page).agg(F.count(F.lit(1)).alias("count"), F.first("__scale").alias("scale"), *sums)
    out = ["Dependent", "Coefficients", "Sigmas", "ReducedChiSquared", "RmsResidual", "Slope", "Intercept", "Terms"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                square = lambda c: np.array([[r[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])  # noqa: E731, B023
                m, inverse = square("m"), np.linalg.pinv(square("m"))
                back = np.ones(k) if chebyshev else r["scale"] ** -np.array(orders, float)
                for y, name in enumerate(ys):
                    v = np.array([r[f"v{y}_{i}"] for i in range(k)])
                    c = np.linalg.lstsq(m, v, rcond=None)[0]
                    rest = max(r[f"s{y}"] - 2 * c @ v + c @ m @ c, 0.0)
                    chi = rest / max(r["count"] - k, 1)
                    if sigma:
                        rest = max(r[f"t{y}"] - 2 * c @ [r[f"u{y}_{i}"] for i in range(k)] + c @ square("n") @ c, 0.0)
                    deviation = np.sqrt(np.maximum(np.diag(inverse), 0) * (1 if sigma else chi))
                    by = dict(zip(orders, (c * back).tolist(), strict=True))
                    rows.append([*[r[x] for x in page], name, (c * back).tolist(), (deviation * back).tolist(), chi, math.sqrt(rest / r["count"]), by.get(1), by.get(0), k])
            yield pd.DataFrame(rows, columns=[*page, *out])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in done.select(*page).schema]
    schema = ", ".join([*kinds, "Dependent string, Coefficients array<double>, Sigmas array<double>, ReducedChiSquared double, RmsResidual double, Slope double, Intercept double, Terms int"])
    return done.mapInPandas(solve, schema)


def polynomial_values(p: Paged, x: str, y: str, orders: Sequence[int], chebyshev: bool = False) -> DataFrame:
    """x, y, `<y>Fit` and `<y>Residual`."""

    def f(c):
        a, v = c[x].astype(float), c[y].astype(float)
        b = _basis(a, orders, chebyshev)
        fit = b @ np.linalg.lstsq(b, v, rcond=None)[0]
        return {x: a, y: v, f"{y}Fit": fit, f"{y}Residual": v - fit}

    return per_page(p, [x, y], f, f"`{x}` double, `{y}` double, `{y}Fit` double, `{y}Residual` double")


def surface(df: DataFrame, x: str, y: str, z: str, max_order: int) -> dict[tuple[int, int], float]:
    """Coefficients of sum c_ij x^i y^j, i + j <= max_order: the sums of the normal equations are aggregated by Spark,
    and only they reach the driver."""
    terms = [(i, j) for i in range(max_order + 1) for j in range(max_order + 1 - i)]
    a, b, v = (F.col(k).cast("double") for k in (x, y, z))
    powers = sorted({(i + k, j + m) for i, j in terms for k, m in terms})
    sums = df.agg(*[F.sum(F.pow(a, F.lit(i)) * F.pow(b, F.lit(j))).alias(f"s{i}_{j}") for i, j in powers], *[F.sum(F.pow(a, F.lit(i)) * F.pow(b, F.lit(j)) * v).alias(f"z{i}_{j}") for i, j in terms]).first()
    m = np.array([[sums[f"s{i + k}_{j + n}"] for k, n in terms] for i, j in terms])
    return dict(zip(terms, np.linalg.lstsq(m, np.array([sums[f"z{i}_{j}"] for i, j in terms]), rcond=None)[0].tolist(), strict=True))


def _model_fit(p: Paged, x: str, y: str, model: Callable, guess: Callable, names: Sequence[str]) -> DataFrame:
    """names, RmsResidual: parameters of model(x, *parameters) by simplex from guess(x, y)."""

    def f(c):
        a, v = c[x].astype(float), c[y].astype(float)
        start = np.asarray(guess(a, v), float)
        cost = lambda q: float(np.mean((v - model(a, *q)) ** 2))
        best = start
        for _ in range(3):  # a restart leaves a simplex that has collapsed early
            best = simplex(cost, best, np.where(np.abs(best) > 1e-12, 0.1 * np.abs(best), 0.1))
        return {n: float(q) for n, q in zip(names, best, strict=True)} | {"RmsResidual": math.sqrt(cost(best))}

    return per_page(p, [x, y], f, ", ".join(f"{n} double" for n in names) + ", RmsResidual double")


def exponential(p: Paged, x: str, y: str) -> DataFrame:
    """expfitConstant + expfitFactor exp(expfitRate x)."""

    def guess(a, v):
        span = (a.max() - a.min()) or 1.0
        rate = (-2.0 if abs(v[-1] - v[len(v) // 2]) < abs(v[len(v) // 2] - v[0]) else 2.0) / span
        b = np.stack([np.ones(len(a)), np.exp(rate * a)], 1)
        return [*np.linalg.lstsq(b, v, rcond=None)[0], rate]

    return _model_fit(p, x, y, lambda a, c, k, r: c + k * np.exp(np.clip(r * a, -700, 700)), guess, ["expfitConstant", "expfitFactor", "expfitRate"])


def gaussian(p: Paged, x: str, y: str) -> DataFrame:
    """gfitBaseline + gfitHeight exp(-(x - gfitMean)^2 / (2 gfitSigma^2))."""

    def guess(a, v):
        base = float(np.median(v[np.argsort(v)[: max(1, len(v) // 5)]]))
        w = np.clip(v - base, 0, None)
        mean = float((w * a).sum() / (w.sum() or 1))
        return [base, float(v.max() - base), mean, float(np.sqrt((w * (a - mean) ** 2).sum() / (w.sum() or 1))) or 1.0]

    return _model_fit(p, x, y, lambda a, b, h, m, s: b + h * np.exp(-0.5 * ((a - m) / (s or 1e-9)) ** 2), guess, ["gfitBaseline", "gfitHeight", "gfitMean", "gfitSigma"])


def lorentzian(p: Paged, x: str, y: str) -> DataFrame:
    """lfitBaseline + lfitHeight / (1 + ((x - lfitCenter) / lfitGamma)^2)."""

    def guess(a, v):
        base, top = float(np.quantile(v, 0.1)), int(np.argmax(v))
        wide = a[v > base + (v[top] - base) / 2]
        return [base, float(v[top] - base), float(a[top]), float((wide.max() - wide.min()) / 2 if len(wide) > 1 else 1.0) or 1.0]

    return _model_fit(p, x, y, lambda a, b, h, m, g: b + h / (1 + ((a - m) / (g or 1e-9)) ** 2), guess, ["lfitBaseline", "lfitHeight", "lfitCenter", "lfitGamma"])


def sine(p: Paged, x: str, y: str, slope: bool = False) -> DataFrame:
    """sinefitConstant + sinefitFactor sin(2 pi sinefitFrequency x + sinefitPhase), with slope also sinefitSlope x."""

    def guess(a, v):
        dt = (a[-1] - a[0]) / max(len(a) - 1, 1) or 1.0
        k = int(np.argmax(np.abs(np.fft.rfft(v - v.mean()))[1:]) + 1)
        q = k / (len(a) * dt)
        fit = np.linalg.lstsq(np.stack([np.ones(len(a)), np.sin(2 * np.pi * q * a), np.cos(2 * np.pi * q * a)], 1), v, rcond=None)[0]
        return [fit[0], float(np.hypot(fit[1], fit[2])), q, float(np.arctan2(fit[2], fit[1]))] + ([0.0] if slope else [])

    names = ["sinefitConstant", "sinefitFactor", "sinefitFrequency", "sinefitPhase"] + (["sinefitSlope"] if slope else [])
    return _model_fit(p, x, y, lambda a, c, k, q, h, m=0.0: c + k * np.sin(2 * np.pi * q * a + h) + m * a, guess, names)


def generic(p: Paged, x: str, y: str, equation: str, start: dict[str, float]) -> DataFrame:
    """Any formula in Python syntax of x's name and the parameters, with numpy's functions; it is parsed first, and
    anything but arithmetic and those functions is refused."""
    import ast

    allowed = {n: getattr(np, n) for n in ("sin", "cos", "tan", "exp", "log", "sqrt", "abs", "arctan", "tanh", "sinh", "cosh")} | {"pi": math.pi}
    tree = ast.parse(equation, mode="eval")
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and node.id not in allowed and node.id not in start and node.id != x:
            raise ValueError(f"unknown name {node.id!r}")
        if not isinstance(node, ast.Expression | ast.BinOp | ast.UnaryOp | ast.Call | ast.Name | ast.Constant | ast.Load | ast.operator | ast.unaryop):
            raise ValueError(f"{type(node).__name__} is refused in a formula")
    names = list(start)

    def model(a, *q):
        return eval(compile(tree, "formula", "eval"), {"__builtins__": {}}, allowed | dict(zip(names, q, strict=True)) | {x: a})  # noqa: S307  checked above

    return _model_fit(p, x, y, model, lambda a, v: list(start.values()), names)


def spline(p: Paged, x: str, y: str, intervals: int, order: int = 4) -> DataFrame:
    """Least-squares B-spline of the given order over equal intervals: x, y, `<y>Fit`, `<y>Residual`."""

    def f(c):
        a, v = c[x].astype(float), c[y].astype(float)
        lo, hi = a.min(), a.max()
        knots = np.r_[[lo] * (order - 1), np.linspace(lo, hi, intervals + 1), [hi] * (order - 1)]
        b = np.zeros((len(a), len(knots) - 1))
        at = np.clip(np.searchsorted(knots, a, "right") - 1, order - 1, len(knots) - order - 1)
        b[np.arange(len(a)), at] = 1
        for k in range(2, order + 1):
            for j in range(len(knots) - k):
                left = (a - knots[j]) / (knots[j + k - 1] - knots[j]) * b[:, j] if knots[j + k - 1] > knots[j] else 0
                right = (knots[j + k] - a) / (knots[j + k] - knots[j + 1]) * b[:, j + 1] if knots[j + k] > knots[j + 1] else 0
                b[:, j] = left + right
        b = b[:, : len(knots) - order]
        fit = b @ np.linalg.lstsq(b, v, rcond=None)[0]
        return {x: a, y: v, f"{y}Fit": fit, f"{y}Residual": v - fit}

    return per_page(p, [x, y], f, f"`{x}` double, `{y}` double, `{y}Fit` double, `{y}Residual` double")
