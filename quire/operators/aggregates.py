"""Envelopes, row statistics, histograms, correlations and line fits, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.frame import Paged, correlation


def _x(column: str) -> Column:
    return F.col(column).cast("double")


def envelope(p: Paged, columns: Sequence[str], statistics: Sequence[str], power: int = 1, group: Sequence[str] = (), x: str | None = None, weight: str | None = None, equal_pages: bool = False) -> DataFrame:
    """Statistics across pages for each row number (and group): `<column><Statistic>`; Slope and Intercept over x,
    W... with weight; Median, DRange, QRange and Percentile<p>. `Row` counts from 0. equal_pages: pages of different
    length are an error."""
    q = p.numbered("Row").rows
    out, names, ordered = [], [], set()
    for c in columns:
        v = _x(c)
        w = _x(weight) if weight else F.lit(1.0)
        wmean = F.sum(w * v) / F.sum(w)
        spread = F.sqrt(F.greatest(F.sum(w * v * v) / F.sum(w) - wmean * wmean, F.lit(0.0)))
        n = F.count(v)
        how = {
            "Max": F.max(v), "Min": F.min(v), "Mean": F.avg(v), "StDev": F.stddev_samp(v), "Rms": F.sqrt(F.avg(v * v)), "Sigma": F.stddev_samp(v) / F.sqrt(n),
            "Sum": F.sum(F.pow(v, F.lit(power)) if power != 1 else v), "Largest": F.max(F.abs(v)), "Slope": F.regr_slope(v, _x(x)) if x else None, "Intercept": F.regr_intercept(v, _x(x)) if x else None,
            "SignedLargest": F.max_by(v, F.struct(F.abs(v).alias("a"), v.alias("v"))), "WMean": wmean, "WRms": F.sqrt(F.sum(w * v * v) / F.sum(w)), "WStDev": spread * F.sqrt(n / F.nullif(n - 1, F.lit(0))),
            "ExmmMean": F.when(n > 2, (F.sum(v) - F.max(v) - F.min(v)) / F.nullif(n - 2, F.lit(0))).otherwise(0.0),
        }
        for s in statistics:
            if s in ORDER_STATISTICS or s.startswith("Percentile"):  # element k of the ascending order, as in reductions
                names.append(f"{c}{s}")
                out.append(_ordered(s, f"__k{c}", f"__n{c}", v).alias(names[-1]))
                ordered.add(c)
            else:
                names.append(f"{c}{power}Sum" if s == "Sum" and power != 1 else f"{c}{s}")
                out.append(how[s].alias(names[-1]))
    across = Window.partitionBy(*group, "Row")
    for c in ordered:  # of one row number there are as many values as pages
        q = q.withColumn(f"__k{c}", F.row_number().over(across.orderBy(_x(c))) - 1).withColumn(f"__n{c}", F.count(F.lit(1)).over(across))
    done = q.groupBy(*group, "Row").agg(*out, F.count(F.lit(1)).alias("__pages"))
    if equal_pages:
        pages = p.rows.select(*p.page).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("__all"))
        done = done.join(pages, list(group)) if group else done.join(pages, F.lit(True))  # one row a group
        checked = F.when(F.col("__pages") == F.col("__all"), F.col("Row")).otherwise(F.raise_error(F.lit("pages differ in length")).cast("int"))
        done = done.withColumn("Row", checked)
    return done.select(*group, "Row", *names)


#: Percentiles between which the statistic is; the median is element n div 2.
ORDER_STATISTICS = {"Median": None, "DRange": (10.0, 90.0), "QRange": (25.0, 75.0)}


def _ordered(statistic: str, k: str, n: str, v: Column) -> Column:
    at = lambda where: F.max(F.when(F.col(k) == where, v))
    percent = lambda q: at(F.floor((F.col(n) - 1) * (q / 100)))
    if statistic == "Median":
        return at(F.floor(F.col(n) / 2))
    if statistic.startswith("Percentile"):
        return percent(float(statistic.removeprefix("Percentile")))
    low, high = ORDER_STATISTICS[statistic]
    return percent(high) - percent(low)


def extreme_partner(p: Paged, column: str, other: str, kind: str = "Maximum") -> DataFrame:
    """`<other>C<kind><column>`: other's value in the page where column is extreme, for each row number."""
    f = F.max_by if kind == "Maximum" else F.min_by
    return p.numbered("Row").rows.groupBy("Row").agg(f(other, F.struct(_x(column), *[F.col(c) for c in p.page])).alias(f"{other}C{kind}{column}"))


def row_statistics(df: DataFrame, columns: Sequence[str], low: float | None = None, high: float | None = None, percentiles: Sequence[float] = ()) -> DataFrame:
    """Statistics across columns: RowMean, RowSum, RowMin, RowMax, RowSpread, RowRms, RowStDev, RowSigma, RowMAD,
    RowMedian, RowDRange, RowQRange, RowPercentile<p>, RowLargest, RowSmallest, RowCount and the names RowMinName, RowMaxName; values outside the limits are
    skipped."""
    cells = F.array(*[F.struct(_x(c).alias("v"), F.lit(c).alias("n")) for c in columns])
    ok = lambda s: s["v"].isNotNull() & ~F.isnan(s["v"]) & (F.lit(True) if low is None else s["v"] >= low) & (F.lit(True) if high is None else s["v"] <= high)
    df = df.withColumn("__c", F.filter(cells, ok)).withColumn("__v", F.transform("__c", lambda s: s["v"])).withColumn("__s", F.sort_array("__v"))
    total = lambda f: F.aggregate("__v", F.lit(0.0), lambda a, v: a + f(v))
    n = F.size("__v")
    df = df.withColumn("RowCount", n).withColumn("RowSum", total(lambda v: v)).withColumn("RowMean", F.col("RowSum") / F.nullif(n, F.lit(0)))
    df = df.withColumn("RowMin", F.array_min("__v")).withColumn("RowMax", F.array_max("__v")).withColumn("RowSpread", F.col("RowMax") - F.col("RowMin"))
    df = df.withColumn("RowRms", F.sqrt(total(lambda v: v * v) / F.nullif(n, F.lit(0)))).withColumn("RowStDev", F.sqrt(total(lambda v: F.pow(v - F.col("RowMean"), F.lit(2))) / F.nullif(n - 1, F.lit(0))))
    df = df.withColumn("RowSigma", F.col("RowStDev") / F.sqrt(n)).withColumn("RowMAD", total(lambda v: F.abs(v - F.col("RowMean"))) / F.nullif(n, F.lit(0)))
    df = df.withColumn("RowMedian", F.get("__s", F.floor(n / 2).cast("int"))).withColumn("RowLargest", F.array_max(F.transform("__v", F.abs))).withColumn("RowSmallest", F.array_min(F.transform("__v", F.abs)))
    element = lambda q: F.get("__s", F.floor((n - 1) * (q / 100)).cast("int"))
    df = df.withColumn("RowDRange", element(90.0) - element(10.0)).withColumn("RowQRange", element(75.0) - element(25.0))
    for q in percentiles:
        df = df.withColumn(f"RowPercentile{q:g}", element(q))
    name = lambda extreme: F.get(F.filter("__c", lambda s: s["v"] == F.col(extreme)), F.lit(0))["n"]
    return df.withColumn("RowMinName", name("RowMin")).withColumn("RowMaxName", name("RowMax")).drop("__c", "__v", "__s")


def histogram(p: Paged, column: str, bins: int = 20, lower: float | None = None, upper: float | None = None, weight: str | None = None, gate: Column | None = None, normalize: str | None = None, size: float | None = None) -> DataFrame:
    """page, `<column>` (bin centre), frequency and `<column>Cdf` of every bin, empty ones too.

    Automatic limits are the page's extremes widened by 1e-7 of the range; a value at the top edge is left out.
    normalize: sum, area or peak. size: width of a bin, instead of bins: the page's range and one bin more, about its middle.
    """
    rows = p.rows.filter(gate) if gate is not None else p.rows
    x, w = _x(column), _x(weight) if weight else F.lit(1.0)
    rows = rows.select(*p.page, x.alias("__x"), w.alias("__w")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    lo, hi = F.min("__x"), F.max("__x")
    pad = F.lit(0.0 if size and lower is None and upper is None else 1e-7) * (hi - lo)  # it would not move the middle
    edges = rows.groupBy(*p.page).agg((F.lit(lower) if lower is not None else lo - pad).cast("double").alias("__lo"), (F.lit(upper) if upper is not None else hi + pad).cast("double").alias("__hi"))
    if size:
        middle, span = (F.col("__lo") + F.col("__hi")) / 2, F.col("__hi") - F.col("__lo") + size
        edges = edges.select(*p.page, (middle - span / 2).alias("__lo"), (middle + span / 2).alias("__hi"), F.lit(float(size)).alias("__d"), F.floor(span / size + 0.5).alias("__bins"))
    else:
        edges = edges.withColumn("__d", (F.col("__hi") - F.col("__lo")) / bins).withColumn("__bins", F.lit(bins).cast("bigint"))
    joined = rows.join(edges, list(p.page)) if p.page else rows.join(edges, F.lit(True))  # one row of edges a page
    binned = joined.withColumn("__b", F.floor((F.col("__x") - F.col("__lo")) / F.nullif(F.col("__d"), F.lit(0.0)))).filter((F.col("__b") >= 0) & (F.col("__b") < F.col("__bins")))
    counted = binned.groupBy(*p.page, "__b").agg(F.sum("__w").alias("__f"))
    grid = edges.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__bins") - 1)))
    out = grid.join(counted, [*p.page, "__b"], "left").withColumn("__f", F.coalesce("__f", F.lit(0.0)))
    over = Window.partitionBy(*p.page)
    total = F.sum("__f").over(over)
    scale = {None: F.lit(1.0), "sum": total, "area": total * F.col("__d"), "peak": F.max("__f").over(over)}[normalize]
    cdf = F.sum("__f").over(over.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) / F.nullif(total, F.lit(0.0))
    return out.select(*p.page, (F.col("__lo") + (F.col("__b") + 0.5) * F.col("__d")).alias(column), (F.col("__f") / F.nullif(scale, F.lit(0.0))).alias("frequency"), cdf.alias(f"{column}Cdf"))


def region_histogram(df: DataFrame, column: str, boundaries: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Counts between sorted boundaries, under the regions' names (one more than boundaries)."""
    index = F.size(F.filter(F.array(*map(F.lit, boundaries)), lambda b: b <= _x(column)))
    counts = df.groupBy(index.alias("__i")).agg(F.count(F.lit(1)).alias("frequency"))
    return counts.select(F.get(F.array(*map(F.lit, names)), F.col("__i")).alias("Region"), "frequency")


def multi_histogram(p: Paged, columns: Sequence[str], bins: int, lower: float, upper: float) -> DataFrame:
    """Several columns on one abscissa: `x`, and `<column>Frequency` of each."""
    long = p.rows.select(*p.page, *[_x(c).alias(c) for c in columns]).unpivot(list(p.page), list(columns), "__name", "__x")
    b = F.floor((F.col("__x") - lower) / ((upper - lower) / bins))
    long = long.withColumn("__b", b).filter((F.col("__b") >= 0) & (F.col("__b") < bins))
    wide = long.groupBy(*p.page, "__b").agg(*[F.count(F.when(F.col("__name") == c, 1)).cast("double").alias(f"{c}Frequency") for c in columns])
    return wide.select(*p.page, (lower + (F.col("__b") + 0.5) * ((upper - lower) / bins)).alias("x"), *[f"{c}Frequency" for c in columns])


def event_histogram(df: DataFrame, column: str, event: str, events: Sequence[str], bins: int, lower: float, upper: float, overlap: str | None = None) -> DataFrame:
    """`<event>Frequency` per bin for each event; with overlap, `<event>.<overlap>Overlap`: the lesser of both."""
    width = (upper - lower) / bins
    rows = df.withColumn("__b", F.floor((_x(column) - lower) / width)).filter((F.col("__b") >= 0) & (F.col("__b") < bins))
    out = rows.groupBy("__b").agg(*[F.count(F.when(F.col(event) == e, 1)).cast("double").alias(f"{e}Frequency") for e in events])
    out = out.withColumn(column, lower + (F.col("__b") + 0.5) * width).drop("__b")
    if overlap:
        for e in events:
            if e != overlap:
                out = out.withColumn(f"{e}.{overlap}Overlap", F.least(F.col(f"{e}Frequency"), F.col(f"{overlap}Frequency")))
    return out


def histogram_2d(df: DataFrame, x: str, y: str, bins: tuple[int, int], x_range: tuple[float, float], y_range: tuple[float, float], weight: str | None = None) -> DataFrame:
    """frequency over the complete grid of bin centres."""
    def cut(c: str, n: int, lo: float, hi: float) -> Column:
        return F.floor((_x(c) - lo) / ((hi - lo) / n))

    rows = df.select(cut(x, bins[0], *x_range).alias("i"), cut(y, bins[1], *y_range).alias("j"), (_x(weight) if weight else F.lit(1.0)).alias("w"))
    rows = rows.filter(F.col("i").between(0, bins[0] - 1) & F.col("j").between(0, bins[1] - 1)).groupBy("i", "j").agg(F.sum("w").alias("f"))
    grid = df.sparkSession.range(bins[0] * bins[1]).select(F.floor(F.col("id") / bins[1]).alias("i"), (F.col("id") % bins[1]).alias("j"))
    centre = lambda k, n, lo, hi: lo + (F.col(k) + 0.5) * ((hi - lo) / n)
    return grid.join(rows, ["i", "j"], "left").select(centre("i", bins[0], *x_range).alias(x), centre("j", bins[1], *y_range).alias(y), F.coalesce("f", F.lit(0.0)).alias("frequency"))


def correlations(p: Paged, columns: Sequence[str], rank: bool = False, significance: bool = False, outlier: float | None = None, passes: int = 1) -> DataFrame:
    """All pairs of columns, in one aggregation: Correlate1Name, Correlate2Name, CorrelatePair, CorrelationCoefficient
    (0 if degenerate), CorrelationPoints. Pages of under 3 rows give none.

    significance: CorrelationSignificance, the probability that uncorrelated values give as much (-1 for under 4 points).
    outlier: values further from their column's mean than so many standard deviations do not count, in so many passes.
    rank: of ranks instead of values; equal values have the mean of their ranks.
    """
    rows = p.rows
    if outlier is not None:
        rows = _without_outliers(p, columns, outlier, passes).rows
    if rank:
        for c in columns:
            w = Window.partitionBy(*p.page).orderBy(_x(c))
            equal = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
            rows = rows.withColumn(c, F.when(_finite(_x(c)), F.rank().over(w) + (equal - 1) / 2))
    pairs = list(combinations(columns, 2))
    both = lambda a, b, c: F.when(_finite(_x(a)) & _finite(_x(b)), _x(c))
    out = [F.struct(F.lit(a).alias("Correlate1Name"), F.lit(b).alias("Correlate2Name"), F.lit(f"{a}.{b}").alias("CorrelatePair"), correlation(both(a, b, a), both(a, b, b)).alias("CorrelationCoefficient"), F.count(both(a, b, a)).alias("CorrelationPoints")) for a, b in pairs]
    done = rows.groupBy(*p.page).agg(F.array(*out).alias("__c"), F.count(F.lit(1)).alias("__n")).filter("__n >= 3")
    found = done.select(*p.page, F.explode("__c").alias("__c")).select(*p.page, "__c.*")
    if significance:
        found = found.withColumn("CorrelationSignificance", correlation_significance(F.col("CorrelationCoefficient"), F.col("CorrelationPoints")))
    return found


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def _without_outliers(p: Paged, columns: Sequence[str], limit: float, passes: int) -> Paged:
    """p with outlying values made null: a pass takes the limits of all columns in one aggregation."""
    rows = p.rows
    for _ in range(passes):
        each = [f(_x(c)).alias(f"__{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]
        limits = rows.groupBy(*p.page).agg(*each)  # one row a page
        joined = rows.join(limits, list(p.page)) if p.page else rows.join(limits, F.lit(True))
        inside = [F.when((F.abs(_x(c) - F.col(f"__m{c}")) <= limit * F.col(f"__s{c}")) | F.col(f"__s{c}").isNull(), F.col(c)).alias(c) for c in columns]
        rows = joined.select(*[c for c in rows.columns if c not in columns], *inside)
    return p.with_rows(rows)


def correlation_significance(r: Column, n: Column) -> Column:
    """Two-tailed probability of |r| or more among n uncorrelated normal pairs: the regularised incomplete beta function
    of 1 - r^2 with (n - 2) / 2 and 1 / 2. -1 for under 4 pairs, which say nothing; 1 for under 2."""

    @F.pandas_udf("double")
    def probability(r: pd.Series, n: pd.Series) -> pd.Series:
        square, points = np.minimum(r.to_numpy(float) ** 2, 1.0), n.to_numpy(float)
        usable = (points >= 4) & (square > 0) & (square < 1)
        a, x = np.where(usable, (points - 2) / 2, 1.0), np.where(usable, 1 - square, 0.5)
        direct = x < (a + 1) / (a + 2.5)  # where the fraction of this side converges soon
        left, right, at = np.where(direct, a, 0.5), np.where(direct, 0.5, a), np.where(direct, x, 1 - x)
        front = np.exp(_log_gamma(a + 0.5) - _log_gamma(a) - _log_gamma(np.full_like(a, 0.5)) + a * np.log(x) + 0.5 * np.log(1 - x))
        value = front * _beta_fraction(left, right, at) / left
        return pd.Series(np.select([points < 2, points < 4, square == 0, square == 1], [1.0, -1.0, 1.0, 0.0], np.where(direct, value, 1 - value)))

    return probability(r, n)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2."""
    from quire.functions.expression import LANCZOS

    base = x + 6.5
    return 0.5 * np.log(2 * np.pi) + (x - 0.5) * np.log(base) - base + np.log(LANCZOS[0] + sum(c / (x + k) for k, c in enumerate(LANCZOS[1:])))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction by Lentz's method, all values at once; the number of steps grows with the root of a."""
    small = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(a), 1 / small(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 200 + 4 * int(np.sqrt(np.maximum(a, b).max(initial=1.0)))):
        change = np.ones_like(a)
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / small(1 + k * d), small(1 + k / c)
            change = change * d * c
            h = h * d * c
        if np.abs(change - 1).max(initial=0.0) < 1e-15:
            break
    return h


def shift_correlation(p: Paged, column: str, other: str, shifts: Sequence[int]) -> DataFrame:
    """Correlation of column with other as it was `ShiftAmount` rows before, for each shift: `<column>ShiftedCor`. Pairs
    of which one is null or not finite do not count."""
    o, x = p.over(), F.col("__x")
    moved = {s: F.lag(_x(other), s).over(o) if s >= 0 else F.lead(_x(other), -s).over(o) for s in shifts}
    rows = p.rows.select(*p.page, _x(column).alias("__x"), *[v.alias(f"__s{i}") for i, v in enumerate(moved.values())])
    both = lambda y: correlation(F.when(_finite(x) & _finite(y), x), F.when(_finite(x) & _finite(y), y))
    out = F.array(*[F.struct(F.lit(s).alias("ShiftAmount"), both(F.col(f"__s{i}")).alias(f"{column}ShiftedCor")) for i, s in enumerate(moved)])
    return rows.groupBy(*p.page).agg(out.alias("__c")).select(*p.page, F.explode("__c").alias("__c")).select(*p.page, "__c.*")


def slopes(p: Paged, x: str, columns: Sequence[str], lower: float | None = None, upper: float | None = None) -> DataFrame:
    """One row per page: `<y>Slope`, `<y>Intercept`, `<y>SlopeSigma`, `<y>InterceptSigma` and `<y>ChiSquared` (reduced)
    of straight-line fits over lower <= x <= upper."""
    rows = p.rows
    if lower is not None:
        rows = rows.filter(_x(x) >= lower)
    if upper is not None:
        rows = rows.filter(_x(x) <= upper)
    a, out = _x(x), []
    for y in columns:
        b = _x(y)
        n, var, cov, mx, my = F.count(b).cast("double"), F.var_pop(a), F.covar_pop(a, b), F.avg(a), F.avg(b)
        slope = cov / F.nullif(var, F.lit(0.0))
        rest = F.greatest(n * (F.var_pop(b) - cov * slope), F.lit(0.0)) / F.nullif(n - 2, F.lit(0.0))
        out += [slope.alias(f"{y}Slope"), (my - slope * mx).alias(f"{y}Intercept"), F.sqrt(rest / (n * var)).alias(f"{y}SlopeSigma"), F.sqrt(rest * (1 / n + mx * mx / (n * var))).alias(f"{y}InterceptSigma"), rest.alias(f"{y}ChiSquared")]
    return p.with_rows(rows).reduce(*out)


def slopes_across_pages(p: Paged, x: str, columns: Sequence[str], row_key: str) -> DataFrame:
    """Straight lines over x, which is constant in a page, for each row key: `<y>Slope`, `<y>Intercept`."""
    out = [f(_x(y), _x(x)).alias(f"{y}{n}") for y in columns for f, n in ((F.regr_slope, "Slope"), (F.regr_intercept, "Intercept"))]
    return p.rows.groupBy(row_key).agg(*out)


def field_average(df: DataFrame, keys: Sequence[str], value: str, power: float = 1.0) -> DataFrame:
    """(mean of value^power)^(1/power) over planes."""
    return df.groupBy(*keys).agg(F.pow(F.avg(F.pow(_x(value), F.lit(power))), F.lit(1 / power)).alias(value))


def ks_statistic(p: Paged, column: str, mean: float, sd: float) -> DataFrame:
    """D, the Kolmogorov-Smirnov distance of each page's values from a normal law; N; and P, the probability to exceed D
    (the series of exponentials with the usual correction for small N)."""
    from quire.functions.expression import ONE

    o = Window.partitionBy(*p.page).orderBy("__x")
    rows = p.rows.select(*p.page, _x(column).alias("__x")).withColumn("__n", F.count(F.lit(1)).over(p.whole())).withColumn("__k", F.row_number().over(o))
    cdf = 0.5 * (1 + ONE["erf"]((F.col("__x") - mean) / (sd * 2**0.5)))
    rows = rows.withColumn("__f", cdf)
    d = F.greatest(F.abs(F.col("__k") / F.col("__n") - F.col("__f")), F.abs((F.col("__k") - 1) / F.col("__n") - F.col("__f")))
    return rows.groupBy(*p.page).agg(F.max(d).alias("D"), F.max("__n").alias("N")).withColumn("P", ks_probability(F.col("D"), F.col("N")))


def ks_probability(d: Column, n: Column, terms: int = 60) -> Column:
    root = F.sqrt(n.cast("double"))
    x = (root + 0.12 + 0.11 / root) * d
    total = F.lit(0.0)
    for j in range(1, terms + 1):
        total = total + F.exp(-2.0 * j * j * x * x) * (2.0 if j % 2 else -2.0)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)))


def density(p: Paged, column: str, bandwidth: float, grid: Sequence[float]) -> DataFrame:
    """Gaussian kernel density at grid points: each row adds to every point in one aggregation, with no row pairs."""
    x = _x(column)
    norm = 1 / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    out = F.array(*[F.struct(F.lit(float(g)).alias(column), (F.avg(F.exp(-F.pow((x - g) / bandwidth, F.lit(2)) / 2)) * norm).alias(f"{column}PDF")) for g in grid])
    return p.rows.groupBy(*p.page).agg(out.alias("__g")).select(*p.page, F.explode("__g").alias("__g")).select(*p.page, "__g.*")


def density_2d(df: DataFrame, x: str, y: str, bandwidth: tuple[float, float], grid: Sequence[tuple[float, float]]) -> DataFrame:
    hx, hy = bandwidth
    norm = 1 / (hx * hy * 2 * 3.141592653589793)
    out = F.array(*[F.struct(F.lit(float(a)).alias(x), F.lit(float(b)).alias(y), (F.avg(F.exp(-(F.pow((_x(x) - a) / hx, F.lit(2)) + F.pow((_x(y) - b) / hy, F.lit(2))) / 2)) * norm).alias("PDF")) for a, b in grid])
    return df.agg(out.alias("__g")).select(F.explode("__g").alias("__g")).select("__g.*")


def local_density(p: Paged, column: str, distance: float, fraction: bool = False) -> Paged:
    """LocalDensity: rows of the page within distance of the row's value, itself included, by a range window; as a
    fraction, distance is one of the page's range of values."""
    page = ", ".join(f"`{c}`" for c in p.page)
    near = f"RANGE BETWEEN {float(distance)!r}D PRECEDING AND {float(distance)!r}D FOLLOWING"
    low, high = F.min(_x(column)).over(p.whole()), F.max(_x(column)).over(p.whole())
    rows = p.rows.withColumn("__at", (_x(column) - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)) if fraction else _x(column))
    return p.with_rows(rows.withColumn("LocalDensity", F.expr(f"count(1) OVER ({'PARTITION BY ' + page if page else ''} ORDER BY `__at` {near})")).drop("__at"))
