"""Reductions of a page's column to a value: every analysis of the process operator.

Plain sums and extremes are aggregates with partial sums before the shuffle. Order statistics are selected
by brackets, so a page is neither sorted nor held. Widths at levels and Gill-Miller integrals
need the whole ordered page and run per page in numpy.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.frame import EMPTY_VALUE, Paged
from quire.frame import correlation as pearson
from quire.functions.wildcard import matches
from quire.operators import selection

SIMPLE = {
    "average": lambda x: F.avg(x), "sum": lambda x: F.sum(x), "rms": lambda x: F.sqrt(F.avg(x * x)), "minimum": lambda x: F.min(x), "maximum": lambda x: F.max(x),
    "smallest": lambda x: F.min(F.abs(x)), "largest": lambda x: F.max(F.abs(x)), "spread": lambda x: F.max(x) - F.min(x), "product": lambda x: F.product(x),
    "standarddeviation": lambda x: F.coalesce(F.stddev_samp(x), F.lit(float("nan"))), "sigma": lambda x: F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(float("nan"))),
    "count": lambda x: F.count(x),
}
#: Element int((n - 1) * p / 100) of the ascending order; the median is element n div 2.
RANGES = {"qrange": (25.0, 75.0), "drange": (10.0, 90.0)}


def _x(column: str) -> Column:
    return F.col(column).cast("double")


def qualified(p: Paged, column: str, match: tuple[str, str] | None = None, function_of: str | None = None, lower: float | None = None, upper: float | None = None, top: float | None = None, bottom: float | None = None, head: int | None = None, tail: int | None = None, fhead: float | None = None, ftail: float | None = None, offset: float = 0.0, factor: float = 1.0) -> Paged:
    """The rows of each page that an analysis of column is to take: those whose match column fits a wildcard, whose
    function_of lies in lower to upper and whose value lies in bottom to top; of these then the first head rows (negative:
    all but those), or as many as the fraction fhead of the whole page's rows; of the rest the last tail, or ftail. Values
    become (x + offset) * factor. Upper bounds leave out what is not finite."""
    x, ok = _x(column), F.lit(True)
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    if match:
        ok = ok & matches(F.col(match[0]), match[1])
    if function_of and lower is not None:
        ok = ok & (_x(function_of) >= lower)
    if function_of and upper is not None:
        ok = ok & (_x(function_of) <= upper) & finite(_x(function_of))
    if top is not None:
        ok = ok & (x <= top) & finite(x)
    if bottom is not None:
        ok = ok & (x >= bottom)
    rows = p.rows.withColumn("__all", F.count(F.lit(1)).over(p.whole())) if fhead is not None or ftail is not None else p.rows
    q = p.with_rows(rows.filter(ok))
    part = lambda fraction: F.floor(F.abs(F.col("__all") * fraction + 0.5))
    ends = [("head", head, None if head is None else abs(head)), ("head", fhead, fhead and part(fhead)), ("tail", tail, None if tail is None else abs(tail)), ("tail", ftail, ftail and part(ftail))]
    for side, value, size in ends:
        if value is not None:
            r = q.numbered().counted()
            place = F.col("__row") if side == "head" else F.col("__rows") - 1 - F.col("__row")
            q = q.with_rows(r.rows.filter(place < size if value > 0 else place >= size).drop("__row", "__rows"))
    rows = q.rows.drop("__all")
    if offset or factor != 1.0:
        rows = rows.withColumn(column, (x + offset) * factor)
    return p.with_rows(rows)


def with_default(p: Paged, reduced: DataFrame, default: float = EMPTY_VALUE) -> DataFrame:
    """One row for each page of p: pages of which no row took part have the default, and counts of 0."""
    pages = (p.params if p.params is not None else p.rows).select(*p.page).distinct()
    named = reduced.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(p.page)], *[c for c in reduced.columns if c not in p.page])
    same = fold(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(p.page)])
    out = [F.coalesce(F.col(c), F.lit(default if kind == "double" else 0).cast(kind)).alias(c) for c, kind in reduced.dtypes if c not in p.page]
    return pages.join(named, same, "left").select(*p.page, *out)


def weighted(column: str, weight: str) -> dict[str, Column]:
    """Weighted average, rms, sum; the deviation needs two passes and is weighted_deviation."""
    x, w = _x(column), _x(weight)
    return {"average": F.sum(w * x) / F.sum(w), "rms": F.sqrt(F.sum(w * x * x) / F.sum(w)), "sum": F.sum(w * x)}


def weighted_deviation(p: Paged, column: str, weight: str, name: str) -> DataFrame:
    """sqrt(sum w (x - m)^2 * n / (sum w * (n - 1))): the factor counts rows, not weights."""
    x, w = _x(column), _x(weight)
    mean = F.sum(w * x).over(p.whole()) / F.sum(w).over(p.whole())
    rows = p.rows.withColumn("__d", w * F.pow(x - mean, 2))
    n = F.count(F.lit(1))
    return rows.groupBy(*p.page).agg(F.sqrt(F.sum("__d") * n / (F.sum(w) * F.when(n > 1, n - 1))).alias(name))


def reduce(p: Paged, column: str, analyses: Iterable[str], prefix: str | None = None) -> DataFrame:
    """Simple analyses, in one aggregation; columns are named `<column><Analysis>`."""
    x, name = _x(column), prefix or column
    return p.reduce(*[SIMPLE[a](x).alias(f"{name}{a.capitalize()}") for a in analyses])


def mean_absolute_deviation(p: Paged, column: str, name: str) -> DataFrame:
    rows = p.rows.withColumn("__d", F.abs(_x(column) - F.avg(_x(column)).over(p.whole())))
    return rows.groupBy(*p.page).agg(F.avg("__d").alias(name))


def order_statistics(p: Paged, column: str, percentiles: dict[str, float | str]) -> DataFrame:
    """name -> percentile, or 'median'. No interpolation and no averaging: always one of the values."""
    return selection.elements(p, column, {name: selection.median() if spec == "median" else selection.percentile(float(spec)) for name, spec in percentiles.items()})


def percentile_range(p: Paged, column: str, low: float, high: float, name: str) -> DataFrame:
    both = order_statistics(p, column, {"__low": low, "__high": high})
    return both.select(*p.page, (F.col("__high") - F.col("__low")).alias(name))


def extreme_position(p: Paged, column: str, position: str, kind: str, name: str) -> DataFrame:
    """The value of `position` where column is smallest, largest, ...; the first such row of the page."""
    x = _x(column)
    key = {"minimum": x, "maximum": -x, "smallest": F.abs(x), "largest": -F.abs(x)}[kind]
    return p.reduce(F.min_by(position, F.struct(key.alias("k"), *p.order)).alias(name))


def signed_extreme(p: Paged, column: str, kind: str, name: str) -> DataFrame:
    """The value, with its sign, of least or greatest magnitude; the first such row."""
    x = _x(column)
    return p.reduce(F.min_by(x, F.struct((F.abs(x) if kind == "smallest" else -F.abs(x)).alias("k"), *p.order)).alias(name))


def first_last(p: Paged, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    out = []
    key = F.struct(*p.order)
    if first:
        out.append(F.min_by(column, key).alias(first))
    if last:
        out.append(F.max_by(column, key).alias(last))
    return p.reduce(*out)


def mode(p: Paged, column: str, name: str, bins: int = 100) -> DataFrame:
    """Centre of the fullest of `bins` bins over the range padded by one bin at each side; the lowest of equals."""
    x = _x(column)
    lo, hi = F.min(x).over(p.whole()), F.max(x).over(p.whole())
    rows = p.rows.select(*p.page, x.alias("__x"), lo.alias("__lo"), hi.alias("__hi"))
    # bins - 2 bins hold the range itself
    rows = rows.withColumn("__w", (F.col("__hi") - F.col("__lo")) / (bins - 2)).withColumn("__b", F.when(F.col("__w") > 0, F.floor((F.col("__x") - F.col("__lo")) / F.col("__w") + 1)).otherwise(F.lit(1)))
    counted = rows.groupBy(*p.page, "__b").agg(F.count(F.lit(1)).alias("__c"), F.first("__lo").alias("__lo"), F.first("__w").alias("__w"))
    best = F.min_by(F.struct("__b", "__lo", "__w"), F.struct(-F.col("__c"), F.col("__b")))
    out = counted.groupBy(*p.page).agg(best.alias("__best"))
    return out.select(*p.page, (F.col("__best.__lo") + (F.col("__best.__b") - 0.5) * F.col("__best.__w")).alias(name))


def line(p: Paged, y: str, x: str, prefix: str) -> DataFrame:
    """Slope, Intercept and residual deviation (divisor n - 2) of y over x; the last is EMPTY_VALUE for n <= 2."""
    a, b = _x(x), _x(y)
    n, sx, sy = F.count(F.lit(1)), F.sum(a), F.sum(b)
    var, cov = F.var_pop(a), F.covar_pop(a, b)
    rest = F.sqrt(F.greatest(n * (F.var_pop(b) - cov * cov / F.nullif(var, F.lit(0.0))), F.lit(0.0)) / F.nullif(n - 2, F.lit(0)))
    return p.reduce(
        (cov / F.nullif(var, F.lit(0.0))).alias(f"{prefix}Slope"), (sy / n - cov / F.nullif(var, F.lit(0.0)) * sx / n).alias(f"{prefix}Intercept"),
        F.when(n <= 2, F.lit(EMPTY_VALUE)).otherwise(rest).alias(f"{prefix}Lfsd"),
    )


def correlation(p: Paged, x: str, y: str, name: str) -> DataFrame:
    a, b = _x(x), _x(y)
    ok = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return p.with_rows(p.rows.filter(ok)).reduce(pearson(a, b).alias(name))


def integral(p: Paged, y: str, x: str, name: str) -> DataFrame:
    """Trapezoids over the page; 0 for one row."""
    a, b = _x(x), _x(y)
    step = (b + F.lag(b).over(p.over())) * (a - F.lag(a).over(p.over())) / 2
    return p.with_rows(p.rows.withColumn("__a", step)).reduce(F.coalesce(F.sum("__a"), F.lit(0.0)).alias(name))


def zero_crossing(p: Paged, y: str, x: str, name: str) -> DataFrame:
    """The first x at which y changes sign, by linear interpolation; null if it never does."""
    a, b = _x(x), _x(y)
    a0, b0 = F.lag(a).over(p.over()), F.lag(b).over(p.over())
    hit = ((b0 <= 0) & (b >= 0)) | ((b0 >= 0) & (b <= 0))
    at = F.when(b == b0, a0).otherwise(a0 - b0 * (a - a0) / F.nullif(b - b0, F.lit(0.0)))
    rows = p.rows.withColumn("__hit", hit).withColumn("__at", at)
    return p.with_rows(rows).reduce(F.min_by(F.when(F.col("__hit"), F.col("__at")), F.when(F.col("__hit"), F.struct(*p.order))).alias(name))


def top_and_base(x: np.ndarray, bins: int = 50) -> tuple[float, float]:
    """Levels of a pulse: the fullest bin in each half of the range, where it stands out of the mean by two of its
    roots; else the extremes."""
    low, high = float(np.min(x)), float(np.max(x))
    if len(x) < 10 or low == high:
        return low, high
    counts, edges = np.histogram(x, bins, (low, high))
    centre, mean, half = (edges[1:] + edges[:-1]) / 2, counts.mean(), bins // 2
    b, t = int(np.argmax(counts[:half])), half + int(np.argmax(counts[half:]))
    base = centre[b] if counts[b] > mean + 2 * np.sqrt(mean) else low
    top = centre[t] if counts[t] > mean + 2 * np.sqrt(mean) else high
    if top - base < 0.75 * (high - base):
        top = high
    return float(base), float(top)


def _crossing(x: np.ndarray, y: np.ndarray, level: float, at: int, step: int) -> float:
    """Where y first reaches level walking from row `at`."""
    while 0 <= at + step < len(y) and (y[at + step] - level) * (y[at] - level) > 0:
        at += step
    nxt = at + step
    if not 0 <= nxt < len(y):
        return float("nan")
    return float(x[at] + (level - y[at]) * (x[nxt] - x[at]) / (y[nxt] - y[at])) if y[nxt] != y[at] else float(x[at])


def pulse(p: Paged, y: str, x: str) -> DataFrame:
    """baselevel, toplevel, amplitude, risetime, falltime (10 to 90 % of amplitude), fwhm, fwtm (full widths at half
    and tenth of maximum above base), fwha, fwta (of amplitude), center, per page."""
    page, order = list(p.page), list(p.order)
    names = ["baselevel", "toplevel", "amplitude", "risetime", "falltime", "fwhm", "fwtm", "fwha", "fwta", "center"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        base, top = top_and_base(b)
        peak, height = int(np.argmax(b)), float(np.max(b))
        first = lambda f, h: _crossing(a, b, base + f * h, peak, -1)
        last = lambda f, h: _crossing(a, b, base + f * h, peak, 1)
        h, amp = height - base, top - base
        out = [base, top, amp, first(0.9, amp) - first(0.1, amp), last(0.1, amp) - last(0.9, amp), last(0.5, h) - first(0.5, h), last(0.1, h) - first(0.1, h), last(0.5, amp) - first(0.5, amp), last(0.1, amp) - first(0.1, amp), (last(0.5, amp) + first(0.5, amp)) / 2]
        return pd.DataFrame([[*pdf[page].iloc[0], *out]], columns=[*page, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.rows.select(*p.page).schema)
    return p.rows.select(*p.page, *p.order, *[c for c in dict.fromkeys((x, y)) if c not in p.order]).groupBy(*p.page).applyInPandas(one, kinds + ", " + ", ".join(f"{n} double" for n in names))
