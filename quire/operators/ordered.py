"""Analytics that depend on the order of a page's rows, as window expressions."""

from __future__ import annotations

import math
from functools import reduce as fold
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.frame import EMPTY_VALUE, Paged
from quire.functions.expression import ONE
from quire.operators import selection

RUNNING = {"Mean": F.avg, "Min": F.min, "Max": F.max, "Sum": F.sum, "StDev": F.stddev_samp}


def _x(column: str) -> Column:
    return F.col(column).cast("double")


def running(p: Paged, column: str, points: int, statistics: list[str], overlap: bool = True, partial: bool = False) -> DataFrame:
    """Statistics of `points` rows from each row on; only complete windows, unless partial. Without overlap the page is
    cut into blocks of `points`. Columns `<column><Statistic>`; page, and `Row` of the window's first row."""
    x, q = _x(column), p.numbered().counted()

    def value(s: str, over) -> Column:
        of = lambda f: f(x).over(over) if over is not None else f(x)
        if s == "RMS":
            return F.sqrt(of(lambda c: F.avg(c * c)))
        if s == "Sigma":
            return of(F.stddev_samp) / F.sqrt(of(F.count))
        if s == "Median":
            ordered = F.sort_array(of(F.collect_list))  # of one window, `points` values at most
            return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))
        return of(RUNNING[s])

    if overlap:
        w = p.over().rowsBetween(0, points - 1)
        rows = q.rows.select(*p.page, F.col("__row").alias("Row"), F.col("__rows"), *[value(s, w).alias(column + s) for s in statistics])
        return (rows if partial else rows.filter(F.col("Row") <= F.col("__rows") - points)).drop("__rows")
    rows = q.rows.withColumn("__block", F.floor(F.col("__row") / points))
    rows = rows if partial else rows.filter((F.col("__block") + 1) * points <= F.col("__rows"))
    return rows.groupBy(*p.page, "__block").agg(*[value(s, None).alias(column + s) for s in statistics]).withColumn("Row", F.col("__block") * points).drop("__block")


def running_slope(p: Paged, y: str, x: str, points: int) -> DataFrame:
    w = p.over().rowsBetween(0, points - 1)
    q = p.numbered().counted()
    slope = F.regr_slope(_x(y), _x(x)).over(w)
    return q.rows.select(*p.page, F.col("__row").alias("Row"), "__rows", slope.alias(f"{y}Slope")).filter(F.col("Row") <= F.col("__rows") - points).drop("__rows")


def running_by_value(p: Paged, column: str, by: str, width: float, statistics: list[str]) -> DataFrame:
    """Statistics of the rows whose `by` lies within width above the row's own; EMPTY_VALUE never occurs, as the row
    itself counts. Rows without a finite `by` count with those that have the same.

    The page is cut into cells of three quarters of the width, so a row's window is the end of its cell from the row on,
    the whole cells between, and the beginning of the cell where the window ends: running statistics of cells, put
    together. No window is walked, so the work does not grow with the number of rows in it, and a cell is a task."""
    if not width >= 0 or math.isinf(width):
        raise ValueError("the width must be finite and not negative")
    at, page, x = _x(by), list(p.page), F.col("__x")
    parts = lambda over: F.struct(*[f.alias(n) if over is None else f.over(over).alias(n) for n, f in (("n", F.count(x)), ("sum", F.sum(x)), ("min", F.min(x)), ("max", F.max(x)), ("mean", F.avg(x)), ("var", F.var_pop(x)))])
    finite = F.abs(at) < float("inf")
    size = 0.75 * width
    where = at / size if size else at
    cell = F.when(finite, F.when(F.abs(where) < 2.0**50, F.floor(where).cast("double")).otherwise(F.raise_error(F.lit("the width is too small for these values")).cast("double")) if size else at)
    kept = [c for c in p.order if c not in page]
    rows = p.rows.select(*page, *kept, _x(column).alias("__x"), at.alias("__at"), cell.alias("__cell"), F.when(~finite, at).alias("__odd"))
    keys = [*page, "__cell", "__odd"]
    rows = rows.withColumn("__own", parts(Window.partitionBy(*keys).orderBy(F.col("__at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    found = [F.col("__own")]
    if size:
        to = F.col("__at") + float(width)
        asked = rows.filter(F.col("__cell").isNotNull()).select(*page, to.alias("__at")).distinct().withColumn("__cell", F.floor(F.col("__at") / size).cast("double"))
        none = F.lit(None).cast("double")
        points = rows.filter(F.col("__cell").isNotNull()).select(*page, "__cell", "__at", "__x", F.lit(False).alias("__ask")).unionByName(asked.select(*page, "__cell", "__at", none.alias("__x"), F.lit(True).alias("__ask")))
        up_to = Window.partitionBy(*page, "__cell").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        begun = points.withColumn("__begun", parts(up_to)).filter("__ask")
        whole = rows.filter(F.col("__cell").isNotNull()).groupBy(*page, "__cell").agg(parts(None).alias("__whole"))  # a row a cell
        begun = begun.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(page)], F.col("__at").alias("__to"), F.col("__cell").alias("__end"), "__begun")
        whole = whole.select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(page)], F.col("__cell").alias("__between"), "__whole")
        same = lambda k, last: fold(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{k}{i}")) for i, c in enumerate(page)], last)
        rows = rows.join(begun, same("__p", F.col("__cell").isNotNull() & (to == F.col("__to"))), "left")
        # a window of four thirds of a cell ends in the next cell or in the one after it
        rows = rows.join(whole, same("__w", (F.col("__cell") + 1 == F.col("__between")) & (F.col("__end") == F.col("__cell") + 2)), "left")
        found += [F.col("__whole"), F.col("__begun")]
    total = lambda k: fold(add, [F.coalesce(f[k], F.lit(0)) for f in found])
    n, one = total("n"), len(found) == 1
    some = F.nullif(n, F.lit(0))
    sum_ = F.when(n > 0, total("sum"))
    mean = sum_ / some
    spread = fold(add, [F.coalesce(f["n"] * (f["var"] + (f["mean"] - mean) * (f["mean"] - mean)), F.lit(0.0)) for f in found])
    least = lambda f, k: found[0][k] if one else f(*[c[k] for c in found])
    values = {"Mean": mean, "Sum": sum_, "Min": least(F.least, "min"), "Max": least(F.greatest, "max"), "StDev": F.sqrt(spread / F.when(n > 1, n - 1))}
    return rows.select(*page, *kept, *[values[s].alias(column + s) for s in statistics])


def smooth(p: Paged, column: str, points: int, passes: int = 1) -> Paged:
    """Boxcar means of points around each row, narrower at the ends; column is replaced."""
    rows, w = p.rows, p.over().rowsBetween(-(points // 2), points // 2)
    for _ in range(passes):
        rows = rows.withColumn(column, F.avg(_x(column)).over(w))
    return p.with_rows(rows)


def difference_from(p: Paged, smoothed: Paged, column: str, name: str) -> Paged:
    """column minus its smoothed form, which must come from the same rows."""
    keys = [*p.page, *p.order]
    other = smoothed.rows.select(*keys, F.col(column).alias("__s"))
    return p.with_rows(p.rows.join(other, keys).withColumn(name, _x(column) - F.col("__s")).drop("__s"))


def median_filter(p: Paged, column: str, points: int, name: str) -> Paged:
    """Element n div 2 of the values around each row."""
    near = F.sort_array(F.collect_list(_x(column)).over(p.over().rowsBetween(-(points // 2), points // 2)))
    return p.with_rows(p.rows.withColumn("__near", near).withColumn(name, F.get("__near", F.floor(F.size("__near") / 2).cast("int"))).drop("__near"))


def savitzky_golay_weights(left: int, right: int, degree: int, derivative: int = 0) -> list[float]:
    import math

    import numpy as np

    t = np.arange(-left, right + 1)
    return (np.linalg.pinv(np.vander(t, degree + 1, increasing=True).astype(float))[derivative] * math.factorial(derivative)).tolist()


def savitzky_golay(p: Paged, column: str, left: int, right: int, degree: int, name: str, derivative: int = 0) -> Paged:
    """Fixed weights on neighbours; rows past an end repeat the end row."""
    x, o = _x(column), p.over()
    first = F.first(x).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(x).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    terms = []
    for k, weight in zip(range(-left, right + 1), savitzky_golay_weights(left, right, degree, derivative), strict=True):
        value = x if k == 0 else F.coalesce(F.lead(x, k).over(o), last) if k > 0 else F.coalesce(F.lag(x, -k).over(o), first)
        terms.append(value * weight)
    return p.with_rows(p.rows.withColumn(name, fold(lambda a, b: a + b, terms)))


def shift(p: Paged, column: str, by: int, mode: str = "hold") -> Paged:
    """`Shifted<column>`: later by `by` rows (earlier, if negative). Rows shifted in hold the end value, are 0 ('zero'),
    or come round ('circular')."""
    x, o = F.col(column), p.over()
    moved = F.lag(x, by).over(o) if by >= 0 else F.lead(x, -by).over(o)
    if mode == "circular":
        q = p.numbered().counted()
        here = q.rows.withColumn("__to", F.pmod(F.col("__row") + by, F.col("__rows")))
        source = here.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(p.page)], F.col("__to"), x.alias(f"Shifted{column}"))
        same = fold(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(p.page)], q.rows["__row"] == source["__to"])
        return p.with_rows(q.rows.join(source, same).drop("__row", "__rows", "__to", *[f"__p{i}" for i in range(len(p.page))]))
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.lit(0) if mode == "zero" else F.first(x).over(whole) if by >= 0 else F.last(x).over(whole)
    inside = F.row_number().over(o) > by if by >= 0 else F.row_number().over(o) <= F.count(F.lit(1)).over(p.whole()) + by
    return p.with_rows(p.rows.withColumn(f"Shifted{column}", F.when(inside, moved).otherwise(edge)))


def unwrap(p: Paged, column: str, threshold: float = 0.5, modulo: float = 1.0) -> Paged:
    """`Unwrap<column>`: k falls by 1 at each step above threshold, rises at each below minus threshold; x + modulo k."""
    step = _x(column) - F.lag(_x(column)).over(p.over())
    rows = p.rows.withColumn("__k", F.when(step > threshold, -1).when(step < -threshold, 1).otherwise(0))
    k = F.sum("__k").over(p.over().rowsBetween(Window.unboundedPreceding, 0))
    return p.with_rows(rows.withColumn(f"Unwrap{column}", _x(column) + modulo * k).drop("__k"))


def derivative(p: Paged, y: str, x: str, interval: int = 2) -> Paged:
    """`<y>Deriv` and `<y>DerivPosition`: the quotient over rows i - h to i + h, h = interval div 2, smaller near the
    ends; the first row uses rows 0 and 1, the last the last two; no span gives EMPTY_VALUE."""
    q = p.numbered().counted()
    rows, i, n, h = q.rows, F.col("__row"), F.col("__rows"), max(1, interval // 2)
    a, b, o = _x(x), _x(y), p.over()
    span = F.least(F.lit(h), i, n - 1 - i)

    def at(value: Column, sign: int) -> Column:
        out = value
        for k in range(1, h + 1):
            moved = F.lead(value, k).over(o) if sign > 0 else F.lag(value, k).over(o)
            out = F.when(span == k, moved).otherwise(out)
        edge = F.lead(value, 1).over(o) if sign > 0 else F.lag(value, 1).over(o)
        return F.when((span == 0) & (i == (0 if sign > 0 else n - 1)), edge).otherwise(out)

    rows = rows.withColumn("__x0", at(a, -1)).withColumn("__x1", at(a, 1)).withColumn("__y0", at(b, -1)).withColumn("__y1", at(b, 1))
    dx = F.col("__x1") - F.col("__x0")
    bad = dx.isNull() | (dx == 0)
    rows = rows.withColumn(f"{y}Deriv", F.when(bad, F.lit(EMPTY_VALUE)).otherwise((F.col("__y1") - F.col("__y0")) / F.when(bad, F.lit(1.0)).otherwise(dx)))
    rows = rows.withColumn(f"{y}DerivPosition", (F.col("__x0") + F.col("__x1")) / 2)
    return p.with_rows(rows.drop("__row", "__rows", "__x0", "__x1", "__y0", "__y1"))


def cumulative_integral(p: Paged, y: str, x: str, name: str) -> Paged:
    """Running sum of trapezoids from 0."""
    step = (_x(y) + F.lag(_x(y)).over(p.over())) * (_x(x) - F.lag(_x(x)).over(p.over())) / 2
    rows = p.rows.withColumn("__a", F.coalesce(step, F.lit(0.0)))
    return p.with_rows(rows.withColumn(name, F.sum("__a").over(p.over().rowsBetween(Window.unboundedPreceding, 0))).drop("__a"))


def peaks(p: Paged, column: str, threshold: float | None = None, points: int = 3, change: float | None = None, x: str | None = None, curvature: float | None = None) -> Paged:
    """Rows at local maxima of at least threshold: (up, down), (flat, down) or (up, flat), so a plateau shows both edges; 5
    and 7 points also need monotone shoulders, and 7 points (up, down). change: on one side at least, the outermost point is lower by more than this part of the peak's
    value (a peak of 0 stays). curvature: least quadratic coefficient, in size, of a parabola over x through the points."""
    over, x, o = x, _x(column), p.over()
    at = {0: x} | {k: F.lead(x, k).over(o) for k in range(1, points // 2 + 1)} | {-k: F.lag(x, k).over(o) for k in range(1, points // 2 + 1)}
    ok = (at[-1] < x) & (at[1] < x)
    if points < 7:
        ok = ok | ((at[-1] == x) & (at[1] < x)) | ((at[-1] < x) & (at[1] == x))
    for k in range(2, points // 2 + 1):
        ok = ok & (at[-k] < at[-k + 1]) & (at[k] < at[k - 1])
    if threshold is not None:
        ok = ok & (x >= threshold)
    if change is not None:
        fall = lambda k: (x - at[k]) / F.nullif(x, F.lit(0.0)) > change
        ok = ok & ((x == 0) | fall(points // 2) | fall(-(points // 2)))
    if curvature is not None:
        ok = ok & (F.abs(_quadratic(at, {k: (_x(over) if k == 0 else F.lead(_x(over), k).over(o) if k > 0 else F.lag(_x(over), -k).over(o)) - _x(over) for k in at})) >= curvature)
    return p.with_rows(p.rows.withColumn("__peak", F.coalesce(ok, F.lit(False))).filter("__peak").drop("__peak"))


def _quadratic(y: dict[int, Column], x: dict[int, Column]) -> Column:
    """Quadratic coefficient of the parabola through (x, y), least squares, from sums of powers."""
    total = lambda f: fold(add, [f(k) for k in x])
    n = float(len(x))
    a, b, c, d = (total(lambda k, e=e: F.pow(x[k], F.lit(e))) for e in (1, 2, 3, 4))
    u, v, w = (total(lambda k, e=e: F.pow(x[k], F.lit(e)) * y[k]) for e in (0, 1, 2))
    det = n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b)
    return (n * (b * w - c * v) - a * (a * w - b * v) + u * (a * c - b * b)) / F.nullif(det, F.lit(0.0))


def zero_crossings(p: Paged, y: str, x: str, offset: float = 0.0) -> DataFrame:
    """x of each pair of rows where y + offset changes sign or touches 0 (a zero sample counts for both its pairs),
    `<y>` = -offset, and `<y>Slope`."""
    a, b, o = _x(x), _x(y) + offset, p.over()
    a0, b0 = F.lag(a).over(o), F.lag(b).over(o)
    rows = p.rows.select(*p.page, a.alias("__a"), b.alias("__b"), a0.alias("__a0"), b0.alias("__b0"))
    rows = rows.filter("(__b0 <= 0 AND __b >= 0) OR (__b0 >= 0 AND __b <= 0)")
    slope = F.when(F.col("__a") == F.col("__a0"), F.lit(EMPTY_VALUE)).otherwise((F.col("__b") - F.col("__b0")) / F.nullif(F.col("__a") - F.col("__a0"), F.lit(0.0)))
    at = F.when(slope == 0, F.col("__a0")).otherwise(F.col("__a0") - F.col("__b0") / F.nullif(slope, F.lit(0.0)))
    return rows.select(*p.page, at.alias(x), F.lit(-offset).alias(y), slope.alias(f"{y}Slope"))


def changes(p: Paged, columns: list[str], baseline_page) -> DataFrame:
    """Each page minus the baseline page, row by row (`ChangeIn<column>`); pages of another length are an error."""
    q = p.numbered().counted()
    key = p.page[0]
    base = q.rows.filter(F.col(key) == baseline_page).select(F.col("__row").alias("__b"), F.col("__rows").alias("__n"), *[F.col(c).alias(f"__0{c}") for c in columns])
    rows = q.rows.filter(F.col(key) != baseline_page).join(base, F.col("__row") == F.col("__b"), "left")
    same = F.coalesce(F.col("__rows") == F.col("__n"), F.lit(False))
    out = [F.when(same, F.col(c) - F.col(f"__0{c}")).otherwise(F.raise_error(F.lit("pages differ in length")).cast("double")).alias(f"ChangeIn{c}") for c in columns]
    return rows.select(*p.page, F.col("__row").alias("Row"), *out)


def outliers(p: Paged, column: str, sigmas: float | None = 2.0, passes: int = 1, mode: str = "remove", unpopular: int | None = None, percentiles: tuple[float, float] | None = None, deviation: float | None = None, chance: float | None = None) -> Paged:
    """Values that break a rule, pass by pass; pages of under 3 rows are left alone. Rules, in order: outside the fullest
    of `unpopular` equal bins of the page's range; outside two percentiles of the page (values of it, not between);
    further than `deviation`, or `sigmas` standard deviations, from the mean of the values still in; so far that the
    chance to see it in as many Gaussian values is under `chance`. remove, mark (IsOutlier), or replace by the last or
    next good value ('last', 'next') or on the line between them ('interpolate')."""
    x, w = _x(column), p.whole()
    rows = selection.with_page_values(p, p.rows.groupBy(*p.page).agg(F.count(F.lit(1)).alias("__all"))).withColumn("__bad", F.lit(False))
    bad = lambda test: F.col("__bad") | F.coalesce((F.col("__all") >= 3) & test, F.lit(False))
    if unpopular:
        low, width = F.min(x).over(w), (F.max(x).over(w) - F.min(x).over(w)) / unpopular
        rows = rows.withColumn("__low", low).withColumn("__width", width).withColumn("__bin", F.floor((x - F.col("__low")) / F.nullif(F.col("__width"), F.lit(0.0))))
        inside = F.when(F.col("__bin") < unpopular, 1)
        rows = rows.withColumn("__n", F.count(inside).over(Window.partitionBy(*p.page, "__bin")))
        fullest = F.max(F.when(inside.isNotNull(), F.struct("__n", -F.col("__bin")))).over(w)
        rows = rows.withColumn("__bad", bad(F.col("__bin") != -fullest["col2"])).drop("__low", "__width", "__bin", "__n")
    if percentiles:
        ends = dict(zip(("__low", "__high"), map(selection.percentile, percentiles), strict=True))
        rows = selection.with_page_values(p.with_rows(rows), selection.elements(p, column, ends))
        rows = rows.withColumn("__bad", bad((x < F.col("__low")) | (x > F.col("__high")))).drop("__low", "__high")
    for _ in range(passes):
        if deviation is not None:
            good = F.when(~F.col("__bad"), x)
            rows = rows.withColumn("__bad", bad(F.abs(x - F.avg(good).over(w)) > deviation))
        for limit in (sigmas, chance):
            if limit is None:
                continue
            good = F.when(~F.col("__bad"), x)
            mean, sd, n = F.avg(good).over(w), F.stddev_samp(good).over(w), F.count(good).over(w)
            if limit is sigmas:
                rows = rows.withColumn("__bad", bad((n >= 3) & (F.abs(x - mean) > sigmas * sd)))
            else:
                rows = rows.withColumn("__z", F.abs(x - mean) / F.nullif(sd, F.lit(0.0)) / 2**0.5).withColumn("__n", n)
                seen = 1 - F.pow(1 - ONE["erfc"](F.col("__z")), F.col("__n"))
                rows = rows.withColumn("__bad", bad(~F.col("__bad") & (seen < chance))).drop("__z", "__n")
    rows = rows.drop("__all")
    if mode == "remove":
        return p.with_rows(rows.filter("NOT __bad").drop("__bad"))
    if mode == "mark":
        return p.with_rows(rows.withColumn("IsOutlier", F.col("__bad").cast("int")).drop("__bad"))
    up_to, from_here = p.over().rowsBetween(Window.unboundedPreceding, 0), p.back().rowsBetween(Window.unboundedPreceding, 0)
    if mode == "interpolate":
        rows = p.with_rows(rows).numbered().rows
        point = F.when(~F.col("__bad"), F.struct(F.col("__row").alias("i"), x.alias("v")))
        rows = rows.withColumn("__a", F.last(point, True).over(up_to)).withColumn("__b", F.last(point, True).over(from_here))
        a, b = F.col("__a"), F.col("__b")
        line = F.when(a["i"] == b["i"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) / F.nullif(b["i"] - a["i"], F.lit(0)) * (F.col("__row") - a["i"]))
        return p.with_rows(rows.withColumn(column, F.coalesce(line, a["v"], b["v"])).drop("__bad", "__row", "__a", "__b"))
    good = F.when(~F.col("__bad"), F.col(column))
    before, after = F.last(good, True).over(up_to), F.last(good, True).over(from_here)
    value = F.coalesce(before, after) if mode == "last" else F.coalesce(after, before)
    return p.with_rows(rows.withColumn("__v", value).withColumn(column, F.col("__v")).drop("__bad", "__v"))


def limits(p: Paged, column: str, low: float | None = None, high: float | None = None, magnitude: float | None = None) -> Paged:
    """Outlier rules by fixed limits."""
    x, ok = _x(column), F.lit(True)
    for bound, test in ((low, lambda v: x >= v), (high, lambda v: x <= v), (magnitude, lambda v: F.abs(x) <= v)):
        if bound is not None:
            ok = ok & test(bound)
    return p.keep(ok)


def subtract_baseline(p: Paged, column: str, end_points: int | None = None, outlier_passes: int | None = None, terms: int = 1, nonnegative: bool = False) -> Paged:
    """column minus its page's baseline: a polynomial in the row number of `terms` terms (1: the mean) through the first
    and last end_points rows, or through all rows but those that `outlier_passes` passes put beyond two deviations.
    nonnegative: what falls below 0 is 0. SelectedForBaselineDetermination says which rows it was."""
    q = p.numbered().counted()
    x, i, n, w = _x(column), F.col("__row"), F.col("__rows"), p.whole()
    if end_points is not None:
        rows = q.rows.withColumn("__in", (i < end_points) | (i >= n - end_points))
    else:
        rows = q.rows.withColumn("__in", F.lit(True))
        for _ in range(outlier_passes or 0):
            good = F.when(F.col("__in"), x)
            rows = rows.withColumn("__in", F.col("__in") & (F.abs(x - F.avg(good).over(w)) <= 2 * F.stddev_pop(good).over(w)))
    if terms == 1:
        fixed = x - F.coalesce(F.avg(F.when(F.col("__in"), x)).over(w), F.lit(0.0))
    elif terms == 2:
        a, b = F.when(F.col("__in"), i.cast("double")), F.when(F.col("__in"), x)
        slope = F.covar_pop(b, a).over(w) / F.nullif(F.var_pop(a).over(w), F.lit(0.0))
        enough = F.count(a).over(w) >= 3
        fixed = F.when(enough, x - (F.avg(b).over(w) + slope * (i - F.avg(a).over(w)))).otherwise(x)
    else:
        raise ValueError("a baseline has one or two terms; fit more with fits.polynomial")
    fixed = F.greatest(fixed, F.lit(0.0)) if nonnegative else fixed
    rows = rows.withColumn(column, fixed).withColumn("SelectedForBaselineDetermination", F.col("__in").cast("int"))
    return p.with_rows(rows.drop("__row", "__rows", "__in"))


def gaussian_smooth(p: Paged, column: str, sigma: float, name: str) -> Paged:
    """Convolution with a Gaussian of sigma rows, cut at six sigma and not scaled to 1: past the ends there is nothing."""
    x, o, reach = _x(column), p.over(), int(6 * sigma)
    terms = []
    for k in range(-reach, reach + 1):
        value = x if k == 0 else F.lead(x, k).over(o) if k > 0 else F.lag(x, -k).over(o)
        terms.append(F.coalesce(value, F.lit(0.0)) * (math.exp(-((k / sigma) ** 2) / 2) / (sigma * math.sqrt(2 * math.pi))))
    return p.with_rows(p.rows.withColumn(name, fold(lambda a, b: a + b, terms)))


def despike(p: Paged, column: str, neighbors: int = 4, passes: int = 1, average_of: int | None = None, threshold: float = 0.0) -> DataFrame:
    """page, order columns and column without spikes. Windows of neighbors rows, half a window apart, are looked at in row
    order: the row furthest from all others of its window (by the sum of distances, and by more than threshold for each
    neighbor) becomes the mean of average_of rows around it. What one window mends the next one sees, so a page runs in
    one task."""
    import numpy as np

    from quire.operators.grouped import per_page

    half, order = (neighbors + 1) // 2, p.order
    around = (average_of or neighbors) // 2

    def f(c):
        v = c[column].astype(float)
        for _ in range(passes):
            mended = 0
            for at in range(0, len(v), half):
                first, last = max(at - half, 0), min(at + half, len(v) - 1)
                if first == last:
                    continue
                near = v[first : last + 1]
                far = np.abs(near[:, None] - near[None]).sum(1)
                worst = int(np.argmax(far))
                if threshold and far[worst] <= threshold * 2 * half:
                    continue
                row = first + worst
                low, high = max(row - around, 0), min(row + around, len(v) - 1)
                v[row] = (v[low : high + 1].sum() - v[row]) / (high - low)
                mended += 1
            if not mended:
                break
        return {**{k: c[k] for k in order}, column: v}

    kinds = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in p.rows.select(*p.order).schema)
    return per_page(p, [*p.order, column], f, f"{kinds}, `{column}` double")


def remove_offsets(p: Paged, column: str, pattern: int = 2, head: float = 1.0, commutation_only: bool = False) -> Paged:
    """Subtract the offsets of a signal that is switched between two states, every half a pattern of rows. The pattern
    starts at a page's first row, or at its second if these two differ. Each state's offset is the mean of its rows among
    the page's first `head` part; fewer than half a pattern of a state there is an error. commutation_only: the mean of
    both offsets is left in the data."""
    q, half, i, w = p.numbered().counted(), pattern // 2, F.col("__row"), p.whole()
    at = lambda k: F.max(F.when(i == k, _x(column))).over(w)
    rows = q.rows.withColumn("__late", F.coalesce(at(0) != at(1), F.lit(False)).cast("int"))
    rows = rows.withColumn("__first", F.pmod(i - F.col("__late"), F.lit(pattern)) < half)
    first, used = F.col("__first"), i < head * F.col("__rows")
    rows = rows.withColumns({k: F.avg(F.when(used & state, _x(column))).over(w) for k, state in (("__a", first), ("__b", ~first))})
    enough = F.least(*[F.count(F.when(used & state, 1)).over(w) for state in (first, ~first)]) >= half
    fixed = F.when(enough, _x(column) - F.when(first, F.col("__a")).otherwise(F.col("__b")) + ((F.col("__a") + F.col("__b")) / 2 if commutation_only else 0.0))
    fixed = fixed.otherwise(F.raise_error(F.lit("too few head rows for both offsets")).cast("double"))
    return p.with_rows(rows.withColumn(column, fixed).drop("__row", "__rows", "__late", "__first", "__a", "__b"))


def clip_tails(p: Paged, column: str, fraction: float | None = None, limit: float | None = None, in_tail: bool = False) -> Paged:
    """From the page's first maximum outwards, either way: from the first value under the limit on, all is 0. The limit is
    `fraction` of the maximum, `limit`, or the lower of both. Pages of under three rows, or with a maximum of 0 or a limit
    below it, stay as they are. in_tail: InTail is 1 for the rows that were clipped."""
    q = p.numbered().counted()
    x, i, w, top, under, peak = _x(column), F.col("__row"), p.whole(), F.col("__top"), F.col("__limit"), F.col("__peak")
    rows = q.rows.withColumn("__top", F.max(x).over(w))
    bounds = [b for b in (None if fraction is None else fraction * top, None if limit is None else F.lit(float(limit))) if b is not None]
    rows = rows.withColumn("__limit", fold(F.least, bounds)).withColumn("__peak", F.min(F.when(x == top, i)).over(w))
    low = (F.col("__rows") >= 3) & (top != 0) & (under >= 0) & (x < under)
    rows = rows.withColumn("__from", F.max(F.when(low & (i < peak), i)).over(w)).withColumn("__to", F.min(F.when(low & (i > peak), i)).over(w))
    rows = rows.withColumn("InTail" if in_tail else "__tail", F.coalesce((i <= F.col("__from")) | (i >= F.col("__to")), F.lit(False)).cast("int"))
    clipped = F.col("InTail" if in_tail else "__tail") == 1
    return p.with_rows(rows.withColumn(column, F.when(clipped, 0.0).otherwise(x)).drop("__row", "__rows", "__top", "__limit", "__peak", "__from", "__to", "__tail"))


def normalize(p: Paged, column: str, by: str = "maximum", name: str | None = None) -> Paged:
    """Divide by a statistic of the page; a factor of 0 leaves the data."""
    x, w = _x(column), p.whole()
    factors = {
        "minimum": F.min(x).over(w), "maximum": F.max(x).over(w), "largest": F.max(F.abs(x)).over(w), "spread": F.max(x).over(w) - F.min(x).over(w),
        "rms": F.sqrt(F.avg(x * x).over(w)), "standarddeviation": F.stddev_samp(x).over(w), "sum": F.sum(x).over(w), "average": F.avg(x).over(w),
        "signedlargest": F.when(F.max(x).over(w) >= -F.min(x).over(w), F.max(x).over(w)).otherwise(F.min(x).over(w)),
    }
    f = factors[by]
    return p.with_rows(p.rows.withColumn("__f", f).withColumn(name or column, F.when(F.col("__f") == 0, x).otherwise(x / F.nullif(F.col("__f"), F.lit(0.0)))).drop("__f"))


def snapshot(p: Paged, key: str, value: str, time: str, at: float) -> DataFrame:
    """Of a change log: the last value of each key at a time."""
    return p.rows.filter(F.col(time) <= at).groupBy(key).agg(F.max_by(value, F.struct(time, *p.order)).alias(value))


def fill_forward(p: Paged, column: str) -> Paged:
    return p.with_rows(p.rows.withColumn(column, F.last(F.col(column), True).over(p.over().rowsBetween(Window.unboundedPreceding, 0))))
