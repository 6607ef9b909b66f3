"""Images as pages: one column per line, or long form (x, y, value)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.frame import Paged
from quire.operators.grouped import per_page


def to_single_column(p: Paged, columns: Sequence[str], value: str = "Image") -> DataFrame:
    """page, Row, Column (index) and value of each pixel."""
    q = p.numbered("Row").rows
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("Column"), F.col(c).cast("double").alias(value)) for i, c in enumerate(columns)]))
    return q.select(*p.page, "Row", cells.alias("__c")).select(*p.page, "Row", "__c.*")


def to_columns(df: DataFrame, keys: Sequence[str], index: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per index."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(index) == i, F.col(value))).alias(n) for i, n in enumerate(names)])


def profile(pixels: DataFrame, keys: Sequence[str], axis: str, value: str, method: str = "integrated", background: float = 0.0) -> DataFrame:
    """Along an axis: the sum (integrated), mean (averaged) or maximum (peak) of the other one's pixels."""
    v = F.col(value).cast("double") - background
    f = {"integrated": F.sum, "averaged": F.avg, "peak": F.max}[method]
    return pixels.groupBy(*keys, axis).agg(f(v).alias("Profile"))


def centre_line(pixels: DataFrame, keys: Sequence[str], axis: str, other: str, value: str, at: int) -> DataFrame:
    return pixels.filter(F.col(other) == at).select(*keys, axis, F.col(value).cast("double").alias("Profile"))


def spot(pixels: DataFrame, keys: Sequence[str], x: str, y: str, value: str, background: float = 0.0, saturation: float | None = None) -> DataFrame:
    """IntegratedSpotIntensity, PeakSpotIntensity, xSpotCentroid, ySpotCentroid, xSpotSigma, ySpotSigma and
    SaturationCount of each image; values under the background count as 0."""
    v = F.greatest(F.col(value).cast("double") - background, F.lit(0.0))
    p = pixels.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), v.alias("__v"), F.col(value).alias("__raw"))
    total = F.nullif(F.sum("__v"), F.lit(0.0))
    mean = lambda c: F.sum(F.col(c) * F.col("__v")) / total
    square = lambda c: F.sum(F.col(c) * F.col(c) * F.col("__v")) / total
    sigma = lambda c: F.sqrt(F.greatest(square(c) - mean(c) * mean(c), F.lit(0.0)))
    over = F.count(F.when(F.col("__raw") >= saturation, 1)) if saturation is not None else F.lit(0).cast("bigint")
    return p.groupBy(*keys).agg(F.sum("__v").alias("IntegratedSpotIntensity"), F.max("__v").alias("PeakSpotIntensity"), mean("__x").alias("xSpotCentroid"), mean("__y").alias("ySpotCentroid"), sigma("__x").alias("xSpotSigma"), sigma("__y").alias("ySpotSigma"), over.alias("SaturationCount"))


def snap_to_grid(p: Paged, column: str, reduce: float = 0.9, guess: float | None = None, most_bins: int | None = None) -> DataFrame:
    """Snap values to the uniform grid they scatter about: bins are made fewer until no two neighbours are occupied;
    column, `<column>Interval` and `<column>Dimension`. It starts with bins of a tenth of `guess`, the grid's supposed
    interval, with most_bins, or with ten bins a row; bins much finer than the scatter may
    separate what belongs together. Values that no number of bins separates stay as they are: interval 0, dimension 1."""

    def f(c):
        v = c[column].astype(float)
        lo, hi, n = v.min(), v.max(), len(v)
        if lo == hi:
            return {column: v, f"{column}Interval": 0.0, f"{column}Dimension": 1}
        pad = (hi - lo) / n
        bins = max(int((hi - lo + 2 * pad) / (guess / 10)) if guess else most_bins or 10 * n, 1)
        while bins >= 1:
            at = np.floor((v - lo + pad) / ((hi - lo + 2 * pad) / bins)).astype(int)
            used = np.unique(at)
            if bins == 1 or len(used) == 1 or np.diff(used).min() > 1:
                break
            bins = max(int(bins * reduce), 1)
        centres = np.array([v[at == b].mean() for b in used])
        delta = (centres[-1] - centres[0]) / max(len(centres) - 1, 1)
        return {column: np.floor((v - centres[0]) / delta + 0.5) * delta + centres[0] if delta else v, f"{column}Interval": float(delta), f"{column}Dimension": len(centres)}

    return per_page(p, [column], f, f"`{column}` double, `{column}Interval` double, `{column}Dimension` int")


def triangulate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Delaunay triangles (rows of point indices) by inserting points one after another."""
    n = len(x)
    span = max(np.ptp(x), np.ptp(y), 1e-9) * 1000
    px, py = np.r_[x, x.mean() - span, x.mean() + span, x.mean()], np.r_[y, y.mean() - span, y.mean() - span, y.mean() + span]
    triangles = {(n, n + 1, n + 2)}
    for i in range(n):
        t = np.array(list(triangles))
        ax, ay, bx, by, cx, cy = (v[t[:, k]] - w[i] for k in range(3) for v, w in ((px, px), (py, py)))
        inside = (ax**2 + ay**2) * (bx * cy - cx * by) - (bx**2 + by**2) * (ax * cy - cx * ay) + (cx**2 + cy**2) * (ax * by - bx * ay) > 0
        edges: dict[tuple[int, int], int] = {}
        for tri in t[inside]:
            for a, b in ((tri[0], tri[1]), (tri[1], tri[2]), (tri[2], tri[0])):
                if edges.pop((b, a), None) is None:
                    edges[(a, b)] = 1
        triangles -= {tuple(tri) for tri in t[inside].tolist()}
        triangles |= {(int(a), int(b), i) for a, b in edges}
    return np.array([t for t in triangles if max(t) < n]).reshape(-1, 3)


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull, counterclockwise, without points on its edges."""
    order = np.lexsort((y, x))
    order = order[np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]]
    angles = np.linspace(0, 2 * np.pi, 64, endpoint=False)
    ends = order[[int(np.argmax(x[order] * np.cos(a) + y[order] * np.sin(a))) for a in angles]]
    ends = ends[np.r_[True, ends[1:] != ends[:-1]]]
    inner = np.ones(len(order), bool)  # strictly inside the polygon of these extreme points
    for a, b in zip(ends, np.roll(ends, -1), strict=True):
        inner &= (x[b] - x[a]) * (y[order] - y[a]) - (y[b] - y[a]) * (x[order] - x[a]) > 0
    order = order[~inner] if len(ends) > 2 else order

    def half(points: np.ndarray) -> list[int]:
        out: list[int] = []
        for k in points.tolist():
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[k] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[k] - x[out[-2]]) <= 0:
                out.pop()
            out.append(k)
        return out[:-1]

    return np.array(half(order) + half(order[::-1]), int)


def _weights(a: np.ndarray, b: np.ndarray, t: Sequence[int]) -> np.ndarray | None:
    """Barycentric coordinates of the origin in the triangle t of points (a, b); none if it is flat."""
    i, j, k = t
    d = (b[j] - b[k]) * (a[i] - a[k]) + (a[k] - a[j]) * (b[i] - b[k])
    if abs(d) < 1e-300:
        return None
    u, w = ((b[k] - b[j]) * a[k] + (a[j] - a[k]) * b[k]) / d, ((b[i] - b[k]) * a[k] + (a[k] - a[i]) * b[k]) / d
    return np.array([u, w, 1 - u - w])


def delaunay_triangle(a: np.ndarray, b: np.ndarray, hull: np.ndarray) -> tuple[tuple[int, ...], np.ndarray] | None:
    """The Delaunay triangle of points (a, b) around the origin, with its weights; none outside the hull. From a triangle
    of hull corners on, the point deepest inside the circumcircle takes the place of a corner, such that the triangle
    still holds the origin and is the lowest there on the paraboloid, until the circle is empty."""
    inside = lambda w: w is not None and bool((w >= -1e-12).all())
    at, weights = None, None
    for j, k in zip(hull[1:-1].tolist(), hull[2:].tolist(), strict=True):
        w = _weights(a, b, (int(hull[0]), j, k))
        if inside(w):
            at, weights = (int(hull[0]), j, k), w
            break
    if at is None:
        return None
    r2, seen = a * a + b * b, set()
    while at not in seen:
        seen.add(at)
        t = list(at)
        plane = np.linalg.solve(np.column_stack([a[t], b[t], np.ones(3)]), r2[t])
        above = r2 - (plane[0] * a + plane[1] * b + plane[2])
        p = int(np.argmin(above))
        if p in at or above[p] >= -1e-12 * (r2[t].max() + abs(plane[2])):
            break
        options = []
        for drop in range(3):
            new = tuple(sorted((*(q for n, q in enumerate(at) if n != drop), p)))
            w = _weights(a, b, new)
            if inside(w):
                options.append((float(w @ r2[list(new)]), new, w))
        if not options:
            break
        _, at, weights = min(options, key=lambda o: o[0])
    return at, weights


def interpolate_scattered(p: Paged, x: str, y: str, z: str, shape: tuple[int, int]) -> DataFrame:
    """Scattered points to a grid over their range, linear in each Delaunay triangle; outside the hull is left out. Only
    the triangles around grid points are looked for, each by a few passes over the page's points. Of points at one place
    the first counts."""

    def f(c):
        a, b, v = (c[k].astype(float) for k in (x, y, z))
        hull = _hull(a, b)
        gx, gy = (g.ravel() for g in np.meshgrid(np.linspace(a.min(), a.max(), shape[0]), np.linspace(b.min(), b.max(), shape[1]), indexing="ij"))
        out = np.full(len(gx), np.nan)
        for i in range(len(gx)):
            found = delaunay_triangle(a - gx[i], b - gy[i], hull)
            if found:
                t, w = found
                out[i] = w @ v[list(t)]
        ok = ~np.isnan(out)
        return {x: gx[ok], y: gy[ok], z: out[ok]}

    return per_page(p, [x, y, z], f, f"`{x}` double, `{y}` double, `{z}` double")


def slice_moments(p: Paged, t: str, columns: Sequence[str], slices: int) -> DataFrame:
    """Particles cut into equal slices of t: count, means, deviations and the first two columns' emittance per slice."""
    v = F.col(t).cast("double")
    lo, hi = F.min(v).over(p.whole()), F.max(v).over(p.whole())
    at = F.least(F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * slices), F.lit(slices - 1))
    rows = p.rows.withColumn("Slice", F.coalesce(at, F.lit(0)).cast("int"))
    a, b = (F.col(c).cast("double") for c in columns[:2])
    emittance = F.sqrt(F.greatest(F.var_pop(a) * F.var_pop(b) - F.pow(F.covar_pop(a, b), F.lit(2)), F.lit(0.0)))
    return rows.groupBy(*p.page, "Slice").agg(F.count(F.lit(1)).alias("Particles"), *[f(F.col(c).cast("double")).alias(f"{c}{n}") for c in columns for f, n in ((F.avg, "Mean"), (F.stddev_pop, "StDev"))], emittance.alias("Emittance"))
