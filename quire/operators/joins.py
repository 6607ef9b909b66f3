"""Lookups between tables. The general one pairs the k-th left row of a key with the k-th right row of it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.frame import Paged
from quire.functions.wildcard import to_regex
from quire.sources.shared import shared_folder

#: Rows of a level that are broadcast at most.
FEW = 1 << 16
_ZERO = {"string": "", "boolean": False}


def _zero(df: DataFrame, c: str) -> Column:
    """What a cleared cell holds: 0 or the empty string."""
    kind = dict(df.dtypes)[c]
    return F.lit(_ZERO.get(kind, 0)).cast(kind)


def _equal(keys: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in keys])


def lookup(left: Paged, right: Paged, on: dict[str, str], take: Sequence[str], fill: bool = False, reuse: bool = False, replace: bool = False) -> DataFrame:
    """Add `take` from right to left where on (left column -> right column) agrees; both may be paged alike.

    Right rows are consumed once, in order: the k-th left row of a key takes the k-th right row; with reuse every left
    row takes the first. Left rows without one go, or with fill get zeros and empty strings. Columns that left has stay
    unless replace. There is never more than one row per left row.
    """
    pages = [c for c in left.page if c in right.page]
    l_keys, r_keys = [*pages, *on], [*pages, *on.values()]
    taken = [c for c in take if replace or c not in left.rows.columns]
    r = right.rows.withColumn("__k", F.row_number().over(Window.partitionBy(*r_keys).orderBy(*right.order)))
    if reuse:
        r = r.filter("__k = 1")
    r = r.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(r_keys)], F.col("__k").alias("__rk"), *[F.col(c).alias(f"__t_{c}") for c in taken])
    rows = left.rows if reuse else left.rows.withColumn("__k", F.row_number().over(Window.partitionBy(*l_keys).orderBy(*left.order)))
    same = _equal([(c, f"__r{i}") for i, c in enumerate(l_keys)])
    if not reuse:
        same = same & (F.col("__k") == F.col("__rk"))
    out = rows.join(r, same, "left" if fill else "inner")
    values = [(F.coalesce(F.col(f"__t_{c}"), _zero(right.rows, c)) if fill else F.col(f"__t_{c}")).alias(c) for c in taken]
    return out.select(*[c for c in left.rows.columns if c not in taken], *values)


def zip_rows(left: Paged, right: Paged, take: Sequence[str], fill: bool = False) -> DataFrame:
    """Row i with row i of the same page."""
    a, b = left.numbered().rows, right.numbered().rows
    b = b.select(*[F.col(c).alias(f"__r_{c}") for c in right.page], F.col("__row").alias("__rrow"), *[F.col(c).alias(f"__t_{c}") for c in take])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in left.page], F.col("__row") == F.col("__rrow"))
    out = a.join(b, same, "left" if fill else "inner")
    values = [(F.coalesce(F.col(f"__t_{c}"), _zero(right.rows, c)) if fill else F.col(f"__t_{c}")).alias(c) for c in take]
    return out.select(*left.rows.columns, *values)


def wildcard_lookup(left: Paged, right: Paged, column: str, pattern: str, take: Sequence[str], max_patterns: int = 10_000) -> DataFrame:
    """right holds patterns; the first, in right's order, that matches the left column gives the values. The pattern
    table is read by the driver, refused beyond max_patterns, and becomes one expression: no row pairs are made."""
    table = right.rows.orderBy(*right.order).select(pattern, *take).limit(max_patterns + 1).collect()
    if len(table) > max_patterns:
        raise ValueError(f"over {max_patterns} patterns")
    kinds = {f.name: f.dataType for f in right.rows.select(*take).schema}
    empty = F.lit(None).cast(right.rows.select(F.struct(*take)).schema[0].dataType)
    found = empty
    for r in reversed(table):
        regex, inverted = to_regex(r[pattern])
        hit = F.col(column).rlike(regex)
        found = F.when(~hit if inverted else hit, F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in take])).otherwise(found)
    return left.rows.withColumn("__m", found).filter("__m IS NOT NULL").select(*left.rows.columns, *[F.col(f"__m.{c}").alias(c) for c in take])


def tolerance_lookup(left: Paged, right: Paged, equal: dict[str, str], near: tuple[str, str], tolerance: float, take: Sequence[str]) -> DataFrame:
    """The first right row, in order, of equal keys whose value is within tolerance (equal, if that is 0). Right rows may
    serve several left rows. What is looked up is each value of the left keys once, and of the right rows of one value the
    first; left rows, whole, only fetch what their value found. Doubles and integers are looked up in running minima, other
    kinds in pairs."""
    a, b = near
    names = left.rows.columns
    asked = left.rows.select(*[F.col(c).alias(f"__l{i}") for i, c in enumerate(equal)], F.col(a).alias("__a")).distinct()
    r = right.rows.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(equal.values())], F.col(b).alias("__near"), F.struct(*right.order).alias("__order"), F.struct(*take).alias("__take"))
    r = r.groupBy(*[f"__r{i}" for i in range(len(equal))], "__near").agg(F.min("__order").alias("__order"), F.min_by("__take", "__order").alias("__take"))
    if 0 < tolerance < 1e300 and {dict(asked.dtypes)["__a"], dict(r.dtypes)["__near"]} <= {"double", "bigint", "int", "smallint", "tinyint"}:
        size, most = F.abs(F.col("__a").cast("double")), tolerance * 2.0**49  # beyond, cells are no finer than the doubles there
        far = asked.filter((size >= most) & (size < float("inf")))
        best = _first_in_windows(asked.filter(size < most), r, tolerance).unionByName(_first_of_pairs(far, r, tolerance))
    else:
        best = _first_of_pairs(asked, r, tolerance)
    back = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__l{i}") for i, c in enumerate(equal)], F.col(a) == F.col("__a"))
    return left.rows.join(best, back).select(*names, "__take.*")


def _first_of_pairs(asked: DataFrame, r: DataFrame, tolerance: float) -> DataFrame:
    """asked with __take of the first r, by a join on cells of the tolerance's width, so only neighbours meet."""
    keys = asked.columns
    cell = lambda c: F.floor(F.col(c).cast("double") / tolerance) if tolerance else F.col(c).cast("double")
    asked = asked.withColumn("__cell", F.explode(F.array(cell("__a") - 1, cell("__a"), cell("__a") + 1)) if tolerance else cell("__a"))
    r = (r.filter(F.abs(F.col("__near").cast("double")) < float("inf")) if tolerance else r).withColumn("__rcell", cell("__near"))
    same = reduce(lambda x, y: x & y, [F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(keys) - 1)], F.col("__cell") == F.col("__rcell"))
    hits = asked.join(r, same & (F.abs(F.col("__a") - F.col("__near")) <= tolerance))
    return hits.groupBy(*keys).agg(F.min_by("__take", "__order").alias("__take"))


def _first_in_windows(asked: DataFrame, r: DataFrame, tolerance: float) -> DataFrame:
    """The same without pairs, which grow with the product of both sides. A window from a - tolerance to a + tolerance is
    the end of one cell, a whole cell or two, and the beginning of another; so what is asked is put among the cell's values,
    in order, and takes the running minimum there: upwards (__up 1) and downwards (-1, by the negated values)."""
    keys, width, at = asked.columns, 0.75 * tolerance, F.col("__a").cast("double")
    cell = lambda x: F.floor(x / width)
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in keys[:-1]], F.col("__a").isNotNull())
    place = lambda up, c, x, tag: F.struct(F.lit(up).alias("__up"), c.alias("__cell"), x.alias("__x"), F.lit(tag).alias("__tag") if isinstance(tag, int) else tag.alias("__tag"))
    asked = _reach(_reach(asked.filter(known), at, tolerance, "__hi"), -at, tolerance, "__lo")
    first, last = cell(-F.col("__lo")), cell(F.col("__hi"))
    whole = F.when(last - first > 1, F.sequence(first + 1, last - 1)).otherwise(F.array().cast("array<bigint>"))
    ends = F.array(place(1, last, F.col("__hi"), F.col("__hi_tag")), place(-1, first, F.col("__lo"), F.col("__lo_tag")))
    asked = asked.select(*keys, F.explode(F.concat(ends, F.transform(whole, lambda c: place(1, c, F.lit(float("inf")), 2)))).alias("__p"))
    near = F.col("__near").cast("double")
    values = r.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in r.columns[: len(keys) - 1]], F.abs(near) < float("inf")))
    values = values.select(*[F.col(f"__r{i}").alias(c) for i, c in enumerate(keys[:-1])], F.explode(F.array(place(1, cell(near), near, 1), place(-1, cell(near), 0.0 - near, 1))).alias("__p"), "__order", "__take")
    both = asked.unionByName(values, allowMissingColumns=True)
    w = Window.partitionBy(*keys[:-1], "__p.__up", "__p.__cell").orderBy("__p.__x", "__p.__tag").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"__first": F.min("__order").over(w), "__found": F.min_by("__take", "__order").over(w)})
    return both.filter("__a IS NOT NULL AND __first IS NOT NULL").groupBy(*keys).agg(F.min_by("__found", "__first").alias("__take"))


def _reach(df: DataFrame, x: Column, tolerance: float, name: str) -> DataFrame:
    """Add name, the double next to x + tolerance, and name_tag: 2 if a value y equal to it is reached, that is if y - x as a
    double is at most the tolerance, else 0. Such are all y up to half of the tolerance's last bit beyond x + tolerance (with
    y there, if that bit is 0); the three are summed exactly, as a double and what is left."""
    half = (math.nextafter(tolerance, math.inf) - tolerance) / 2
    even = half == 0 or tolerance / math.ulp(tolerance) % 2 == 0
    columns = df.columns

    def add(df: DataFrame, u: Column, v: Column, total: str, left: str) -> DataFrame:
        df = df.withColumn(total, u + v).withColumn("__v", F.col(total) - u)
        return df.withColumn(left, (u - (F.col(total) - F.col("__v"))) + (v - F.col("__v")))

    df = add(df.withColumn("__x0", x), F.col("__x0"), F.lit(tolerance), "__s", "__e")
    df = add(df, F.col("__e"), F.lit(half), "__e1", "__e2")
    df = add(df, F.col("__s"), F.col("__e1"), name, "__f")
    rest = F.col("__f") + F.col("__e2")
    return df.select(*columns, name, F.when((rest >= 0) if even else (rest > 0), 2).otherwise(0).alias(f"{name}_tag"))


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as it says."""
    return df.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), times))).drop("__i", times)


def matching_rows(left: Paged, right: Paged, on: dict[str, str], invert: bool = False, reuse: bool = True) -> DataFrame:
    """Left rows that have a partner (or none, inverted). Without reuse each right row serves one left row."""
    if reuse:
        r = right.rows.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(on.values())])
        return left.rows.join(r, _equal([(c, f"__r{i}") for i, c in enumerate(on)]), "left_anti" if invert else "left_semi")
    l = left.rows.withColumn("__k", F.row_number().over(Window.partitionBy(*on).orderBy(*left.order)))
    r = right.rows.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(on.values())], F.row_number().over(Window.partitionBy(*on.values()).orderBy(*right.order)).alias("__rk"))
    same = _equal([(c, f"__r{i}") for i, c in enumerate(on)]) & (F.col("__k") == F.col("__rk"))
    return l.join(r, same, "left_anti" if invert else "left_semi").drop("__k")


def differences(a: Paged, b: Paged, columns: Sequence[str], tolerance: float = 0.0, relative: float = 0.0) -> DataFrame:
    """Cells that differ, row by row: page, Row, Column, First, Second. Rows that one side lacks differ in all columns."""
    x = a.numbered("Row").rows.select(*a.page, "Row", *[F.col(c).cast("double").alias(f"__a_{c}") for c in columns], F.lit(True).alias("__ina"))
    y = b.numbered("Row").rows.select(*b.page, "Row", *[F.col(c).cast("double").alias(f"__b_{c}") for c in columns], F.lit(True).alias("__inb"))
    both = x.join(y, [*a.page, "Row"], "full")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("Column"), F.col(f"__a_{c}").alias("First"), F.col(f"__b_{c}").alias("Second")) for c in columns]))
    out = both.select(*a.page, "Row", (F.col("__ina").isNull() | F.col("__inb").isNull()).alias("__alone"), cells.alias("__c")).select(*a.page, "Row", "__alone", "__c.*")
    limit = F.greatest(F.lit(tolerance), F.least(F.abs("First"), F.abs("Second")) * relative)
    broken = F.isnan("First") != F.isnan("Second")
    return out.filter(F.col("__alone") | broken | (F.abs(F.col("First") - F.col("Second")) > limit)).drop("__alone")


def interpolate(data: Paged, x: str, y: str, at: DataFrame, value: str, outside: str | float = "saturate") -> DataFrame:
    """Linear interpolation of y(x) of each page at the values of `at` (with the page columns, or none): both are merged
    and sorted, and each value takes the nearest data row before and after it. outside: saturate, skip, extrapolate, wrap
    (by whole ranges of the page's x), abort, or a number to give."""
    page = list(data.page)
    points = data.rows.groupBy(*page, F.col(x).cast("double").alias("__x")).agg(F.avg(F.col(y).cast("double")).alias("__y"))
    o = Window.partitionBy(*page).orderBy("__x")
    points = points.withColumn("__pt", F.struct("__x", "__y")).withColumn("__prev", F.lag("__pt").over(o)).withColumn("__next", F.lead("__pt").over(o))
    wanted = at.select(*[c for c in page if c in at.columns], F.col(value).cast("double").alias("__x"))
    missing = [c for c in page if c not in at.columns]
    if missing:
        wanted = _for_each_page(wanted, data, missing)
    wanted = wanted.withColumn("__asked", F.col("__x"))
    if outside == "wrap":
        wanted = _wrapped(wanted, points, page)
    none = F.lit(None).cast("struct<__x:double,__y:double>")
    merged = points.select(*page, "__x", "__pt", "__prev", "__next", F.lit(0).alias("__is"), F.lit(None).cast("double").alias("__asked")).unionByName(wanted.select(*page, "__x", "__asked", none.alias("__pt"), none.alias("__prev"), none.alias("__next"), F.lit(1).alias("__is")))
    w, back = Window.partitionBy(*page).orderBy("__x", "__is"), Window.partitionBy(*page).orderBy(F.col("__x").desc(), F.col("__is").desc())
    node = F.when(F.col("__is") == 0, F.struct("__pt", "__prev", "__next"))
    merged = merged.withColumn("__before", F.last(node, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__after", F.last(node, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    b, a = F.col("__before.__pt"), F.col("__after.__pt")
    line = lambda p, q: p["__y"] + (F.col("__x") - p["__x"]) * (q["__y"] - p["__y"]) / F.nullif(q["__x"] - p["__x"], F.lit(0.0))
    below, above = b.isNull(), a.isNull()
    refused = F.raise_error(F.lit("a value lies outside the data")).cast("double")
    edge = {"saturate": (a["__y"], b["__y"]), "wrap": (a["__y"], b["__y"]), "skip": (F.lit(None).cast("double"),) * 2, "abort": (refused,) * 2, "extrapolate": (line(a, F.col("__after.__next")), line(F.col("__before.__prev"), b))}
    edge = edge[outside] if isinstance(outside, str) else (F.lit(float(outside)),) * 2
    out = F.when(below, edge[0]).when(b["__x"] == F.col("__x"), b["__y"]).when(above, edge[1]).otherwise(line(b, a))
    result = merged.withColumn("__v", out).filter("__is = 1").select(*page, F.col("__asked").alias(x), F.col("__v").alias(y))
    return result.filter(F.col(y).isNotNull()) if outside == "skip" else result


def _wrapped(wanted: DataFrame, points: DataFrame, page: list[str]) -> DataFrame:
    """wanted with __x moved into the range of its page's points by whole ranges; ends are one row a page."""
    ends = points.groupBy(*page).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    ends = ends.select(*[F.col(c).alias(f"__e_{c}") for c in page], "__lo", "__hi")
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"__e_{c}")) for c in page], F.lit(True))
    lo, hi, x = F.col("__lo"), F.col("__hi"), F.col("__x")
    span = F.nullif(hi - lo, F.lit(0.0))
    moved = F.when(x > hi, x - F.ceil((x - hi) / span) * span).when(x < lo, x + F.ceil((lo - x) / span) * span).otherwise(x)
    return wanted.join(ends, same).withColumn("__x", F.coalesce(moved, lo)).drop("__lo", "__hi", *[f"__e_{c}" for c in page])


def _for_each_page(wanted: DataFrame, data: Paged, missing: list[str]) -> DataFrame:
    """Values asked of every page: one row per page and value is what the result has."""
    pages = data.rows.select(*missing).distinct()
    return wanted.join(pages, F.lit(True))


def inside_polygon(df: DataFrame, x: str, y: str, corners: Sequence[tuple[float, float]], name: str = "InsideSum") -> DataFrame:
    """Winding number of a closed polygon around each point; not 0 is inside. The polygon is part of the expression."""
    edges = list(zip(corners, [*corners[1:], corners[0]], strict=True))
    px, py, total = F.col(x).cast("double"), F.col(y).cast("double"), F.lit(0)
    for (x0, y0), (x1, y1) in edges:
        side = (x1 - x0) * (py - y0) - (px - x0) * (y1 - y0)
        total = total + F.when((py >= y0) & (py < y1) & (side > 0), 1).when((py < y0) & (py >= y1) & (side < 0), -1).otherwise(0)
    return df.withColumn(name, total)


def nearest_in_grid(points: DataFrame, grid: DataFrame, x: str, y: str, cell: float, take: Sequence[str]) -> DataFrame:
    """The grid row nearest to each point; ties by the grid's x, then y. A point is searched for in its own and the
    neighbouring cells. Where no row there is within a cell, and so proven nearest, the first of ever doubled cells around
    which there are rows bounds the distance, and cells of four times that size hold the nearest row. Points and grid
    rows without finite coordinates are left out."""
    finite = F.abs(F.col(x).cast("double")) + F.abs(F.col(y).cast("double")) < float("inf")
    grid = grid.filter(finite)
    all_ = points.filter(finite).withColumn("__p", F.monotonically_increasing_id()).withColumn("__level", F.lit(0)).persist()
    best = _nearest_around(all_, grid, x, y, cell, [0], take).persist()
    proven = best.filter(F.col("__near.d") <= cell * cell * (1 - 1e-9))  # rows outside are farther than a cell
    rest = all_.join(proven.select("__p"), "__p", "left_anti").drop("__level")
    if not rest.isEmpty():
        ends = [F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in (x, y)]
        far = max(v or 0.0 for d in (rest, grid) for v in d.agg(*ends).first())
        levels = range(max(1, math.ceil(math.log2(2 * far / cell + 1))) + 1)  # around the last one is all of the grid
        level, size = F.col("__k"), F.lit(cell) * F.pow(F.lit(2.0), "__k")
        every = F.explode(F.array(*map(F.lit, levels))).alias("__k")
        held = grid.select(x, y, every).select(level, F.floor(F.col(x).cast("double") / size).alias("__gi"), F.floor(F.col(y).cast("double") / size).alias("__gj")).distinct().withColumnRenamed("__k", "__gk")
        asked = rest.select("__p", x, y, every).withColumn("__c", _around(x, y, size))
        first = asked.join(held, (level == F.col("__gk")) & (F.col("__c.i") == F.col("__gi")) & (F.col("__c.j") == F.col("__gj"))).groupBy("__p").agg((F.min("__k") + 2).alias("__level"))
        found = rest.join(first, "__p").select(*all_.columns).persist()
        wanted = [r[0] for r in found.select("__level").distinct().collect()]  # at most one a level
        if wanted:
            proven = proven.unionByName(_nearest_around(found, grid, x, y, cell, wanted, take))
    return proven.select(*points.columns, "__take.*")


def _around(x: str, y: str, size: Column) -> Column:
    """One row for each cell of the 3 x 3 around a point."""
    i, j = (F.floor(F.col(c).cast("double") / size) for c in (x, y))
    return F.explode(F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))


def _nearest_around(points: DataFrame, grid: DataFrame, x: str, y: str, cell: float, levels: Sequence[int], take: Sequence[str]) -> DataFrame:
    """points with __near (d, the squared distance) and __take of the nearest grid row in the 3 x 3 cells of size
    cell * 2^__level, one of levels, if any is there."""
    size = lambda k: F.lit(cell) * F.pow(F.lit(2.0), k)
    p = points.withColumn("__c", _around(x, y, size("__level")))
    g = grid.withColumn("__gk", F.explode(F.array(*map(F.lit, levels))))
    cells = [F.floor(F.col(c).cast("double") / size("__gk")).alias(n) for c, n in ((x, "__gi"), (y, "__gj"))]
    g = g.select(F.col(x).cast("double").alias("__gx"), F.col(y).cast("double").alias("__gy"), "__gk", *cells, F.struct(*take).alias("__take"))
    hits = p.join(g, (F.col("__level") == F.col("__gk")) & (F.col("__c.i") == F.col("__gi")) & (F.col("__c.j") == F.col("__gj")))
    near = F.struct((F.pow(F.col(x) - F.col("__gx"), 2) + F.pow(F.col(y) - F.col("__gy"), 2)).alias("d"), "__gx", "__gy")
    return hits.groupBy(*points.columns).agg(F.min(near).alias("__near"), F.min_by("__take", near).alias("__take"))


def polynomial(df: DataFrame, terms: Sequence[tuple[float, dict[str, int]]], name: str) -> DataFrame:
    """Sum of coefficient times powers of columns; terms as [(coefficient, {column: power})]."""
    total = F.lit(0.0)
    for c, powers in terms:
        total = total + reduce(lambda a, b: a * b, [F.pow(F.col(k).cast("double"), F.lit(float(n))) for k, n in powers.items()], F.lit(float(c)))
    return df.withColumn(name, total)


def dereference(p: Paged, index: Column, source: str, name: str) -> DataFrame:
    """name = source of the page's row number `index`; rows whose index is out of bounds go."""
    q = p.numbered().rows.withColumn("__want", index.cast("int"))
    s = p.numbered().rows.select(*[F.col(c).alias(f"__r_{c}") for c in p.page], F.col("__row").alias("__at"), F.col(source).alias(name))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in p.page], F.col("__want") == F.col("__at"))
    return q.join(s, same).select(*p.rows.columns, name)


def interpolate_polynomial(data: Paged, x: str, y: str, values: Sequence[float], order: int) -> DataFrame:
    """Lagrange interpolation of the given order through the nearest rows, at fixed values: x and y per page."""
    import numpy as np

    from quire.operators.grouped import per_page

    def f(c):
        a, first = np.unique(c[x].astype(float), return_index=True)
        b = c[y].astype(float)[first]
        n, out = min(order + 1, len(a)), []
        for v in values:
            at = int(np.clip(np.searchsorted(a, v) - n // 2, 0, len(a) - n))
            t, u = a[at : at + n], b[at : at + n]
            out.append(sum(u[i] * np.prod([(v - t[j]) / (t[i] - t[j]) for j in range(n) if j != i]) for i in range(n)))
        return {x: np.array(values, float), y: np.array(out)}

    return per_page(data, [x, y], f, f"`{x}` double, `{y}` double")


def interpolate_set(files: dict[str, Paged], x: str, y: str, at: float, name: str = "File") -> DataFrame:
    """y at one x in each of several tables: File and y."""
    out = None
    for key, p in files.items():
        wanted = p.rows.sparkSession.range(1).select(F.lit(float(at)).alias("__at"))
        one = interpolate(p, x, y, wanted, "__at").select(F.lit(key).alias(name), y)
        out = one if out is None else out.unionByName(one)
    return out


def interpolate_by_model(data: Paged, model: DataFrame, x: str, y: str, at: DataFrame, value: str) -> DataFrame:
    """Between data rows y follows the model's shape: the ratio y / model is interpolated and multiplied back. A value
    asked for several times is computed once and comes out as often."""
    m, page = Paged(model, (), (x,)), [c for c in data.page if c in at.columns]
    asked = at.groupBy(*page, F.col(value).cast("double").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    on_data = interpolate(m, x, y, data.rows.select(F.col(x).alias("__at")).distinct(), "__at").withColumnRenamed(y, "__m").withColumnRenamed(x, "__x")
    ratio = data.rows.join(on_data, F.col(x).cast("double") == F.col("__x")).withColumn("__ratio", F.col(y) / F.nullif(F.col("__m"), F.lit(0.0)))
    r = interpolate(data.with_rows(ratio), x, "__ratio", asked, "__at")
    on_values = interpolate(m, x, y, asked.select("__at").distinct(), "__at").select(F.col(x).alias("__x"), F.col(y).alias("__m"))
    out = r.join(on_values, F.col(x) == F.col("__x")).select(*data.page, x, (F.col("__ratio") * F.col("__m")).alias(y))
    times = asked.select(*[F.col(c).alias(f"__p_{c}") for c in page], "__at", "__n")
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"__p_{c}")) for c in page], F.col(x) == F.col("__at"))
    return _repeated(out.join(times, same).select(*data.page, x, y, "__n"), "__n")


def descendants(edges: DataFrame, roots: DataFrame, parent: str, child: str, most_levels: int = 100) -> DataFrame:
    """root, node and level of everything under each root of a dependency table; a cycle ends where it meets itself.
    The edges are made distinct once. Each level is one join with them, by broadcast of the level's nodes where these are at
    most FEW and never of the edges; it is checkpointed in the shared folder, so plans stay short and a lost executor costs
    no level again."""
    found = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).alias("level"))
    spark = found.sparkSession
    folder = shared_folder(spark, "edges")
    edges.select(F.col(parent).alias("__p"), F.col(child).alias("__c")).distinct().write.parquet(folder)
    edge = spark.read.parquet(folder)
    _checkpoint_dir(found)
    level, all_, n, total = found, found, found.count(), 0
    for k in range(1, most_levels + 1):
        total += n
        level = _few(level, n).join(edge, F.col("node") == F.col("__p"))
        level = level.select("root", F.col("__c").alias("node"), F.lit(k).alias("level")).distinct()
        level = level.join(_few(all_.select("root", "node"), total), ["root", "node"], "left_anti").checkpoint()
        n = level.count()
        if not n:
            return all_
        all_ = all_.unionByName(level)
    raise RuntimeError("the dependency table is too deep")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df.hint("shuffle_merge")


def _checkpoint_dir(df: DataFrame) -> None:
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
