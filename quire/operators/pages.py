"""Sorting, combining, breaking and reshaping of pages."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.frame import Paged
from quire.operators.grouped import per_page


def sort_rows(df: DataFrame, *by: str) -> DataFrame:
    """`-name` falls. NaN comes after all numbers ascending, as in Spark; strings compare by bytes."""
    return df.orderBy(*[F.col(b[1:]).desc() if b.startswith("-") else F.col(b).asc() for b in by])


def numeric_high_key(column: str, width: int = 20) -> Column:
    """A key that sorts strings by their text part, then by the number that ends them."""
    number = F.regexp_extract(column, r"(\d+)$", 1)
    return F.concat(F.regexp_replace(column, r"\d+$", ""), F.lpad(number, width, "0"))


def unique(p: Paged, *keys: str, count: bool = False) -> Paged:
    """The first row of each key in a page; IdenticalCount says how many there were."""
    w = Window.partitionBy(*p.page, *keys)
    rows = p.rows.withColumn("__k", F.row_number().over(w.orderBy(*p.order)))
    if count:
        rows = rows.withColumn("IdenticalCount", F.count(F.lit(1)).over(w))
    return p.with_rows(rows.filter("__k = 1").drop("__k"))


def pareto(p: Paged, *columns: str) -> Paged:
    """Rows that no other row of the page dominates (all columns less or equal, one less).

    Of two columns the front is found by sorting: a row is on it if its second value is the least of its first value, and
    less than that of all smaller first values. These minima are one row per first value, found by aggregation. With more
    columns, rows are compared with the distinct rows of their page, which is quadratic in those.
    """
    if len(columns) == 2:
        x, y = columns
        least = p.rows.groupBy(*p.page, F.col(x).alias("__x")).agg(F.min(y).alias("__y"))
        before = F.min("__y").over(Window.partitionBy(*p.page).orderBy("__x").rowsBetween(Window.unboundedPreceding, -1))
        least = least.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__y") < F.col("__before")))
        least = least.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(p.page)], "__x", "__y")
        same = [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(p.page)]
        return p.with_rows(p.rows.join(least, reduce(and_, [*same, F.col(x) == F.col("__x"), F.col(y) == F.col("__y")]), "left_semi"))
    a, b = p.rows.alias("a"), p.rows.select(*p.page, *columns).distinct().alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in p.page]
    no_worse = [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in columns]
    better = reduce(or_, [F.col(f"b.{c}") < F.col(f"a.{c}") for c in columns])
    return p.with_rows(a.join(b, reduce(and_, [*same, *no_worse, better]), "left_anti"))


def pareto_ranks(p: Paged, columns: Sequence[str], maximize: Sequence[str] = ()) -> DataFrame:
    """page, order columns, columns and Rank: 1 for rows of the front, 2 for the front of the rest, and so on. Less is
    better but for columns of maximize. Equal rows have one rank. Rows of a page are taken in ascending order; a row belongs
    to the first front without a row that dominates it. Of two columns that front is found by bisection."""

    def ranks(c):
        values = np.stack([(-1.0 if x in maximize else 1.0) * c[x].astype(float) for x in columns], 1)
        out = np.zeros(len(values), np.int64)
        last: list[tuple[float, float]] = []  # of two columns: each front's last row, ascending
        fronts: list[list[np.ndarray]] = []
        for i in np.lexsort(values.T[::-1]):
            v = values[i]
            if len(columns) == 2:
                mark = (v[1], v[0])
                k = bisect_left(last, mark)
                last[k : k + 1] = [mark]
            else:
                k = next((k for k, f in enumerate(fronts) if not any((u <= v).all() and (u < v).any() for u in f)), len(fronts))
                fronts[k : k + 1] = [[*(fronts[k] if k < len(fronts) else []), v]]
            out[i] = k + 1
        return {x: c[x] for x in [*keys, *columns]} | {"Rank": out}

    keys = [x for x in p.order if x not in (*p.page, *columns)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.rows.select(*keys, *columns).schema)
    return per_page(p, [*keys, *columns], ranks, f"{kinds}, Rank bigint")


def sort_columns(df: DataFrame, decreasing: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """Columns by name, or those of `order` first."""
    first = [c for c in order or () if c in df.columns]
    return df.select(*first, *sorted((c for c in df.columns if c not in first), reverse=decreasing))


def duplicate(df: DataFrame, times: Column, draw_by: Sequence[str] = (), seed: int = 1) -> DataFrame:
    """Each row times (truncated) over, with its copy number. With draw_by, columns that tell rows apart, what truncation
    takes off is the probability of one more copy; a row's draw is a hash of these columns and the seed, so reruns agree."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *draw_by), F.lit(1 << 53)) / float(1 << 53) if draw_by else F.lit(0.0)
    n = F.floor(times + draw).cast("int")
    return df.filter(n > 0).withColumn("Copy", F.explode(F.sequence(F.lit(0), n - 1)))


def combine(**frames: DataFrame) -> DataFrame:
    """All rows of all frames, with Filename, the frame's name; columns a frame lacks are null."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("Filename", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("NumberCombined", F.lit(len(frames)))


def sparse_groups(p: Paged, column: str, k: int, how: str = "average") -> DataFrame:
    """One value for every k rows of a page."""
    q = p.numbered()
    f = {"average": F.avg, "minimum": F.min, "maximum": F.max, "sum": F.sum}[how]
    return q.rows.groupBy(*p.page, F.floor(F.col("__row") / k).alias("Group")).agg(f(F.col(column).cast("double")).alias(column))


def combine_logs(frames: dict[str, DataFrame], time: str = "Time", value: str = "value") -> DataFrame:
    """A column per name, at the times all names have."""
    out = None
    for name, df in frames.items():
        df = df.select(time, F.col(value).alias(name))
        out = df if out is None else out.join(df, time)
    return out


def _broken(p: Paged, boundary: Column, name: str) -> Paged:
    rows = p.rows.withColumn("__new", F.coalesce(boundary, F.lit(False)).cast("int"))
    part = F.sum("__new").over(p.over().rowsBetween(Window.unboundedPreceding, 0))
    return Paged(rows.withColumn(name, part.cast("int")).drop("__new"), (*p.page, name), p.order)


def break_at_gap(p: Paged, column: str, amount: float, name: str = "Part") -> Paged:
    """A new page where the column jumps by amount or more, either way."""
    x = F.col(column).cast("double")
    return _broken(p, F.abs(x - F.lag(x).over(p.over())) >= amount, name)


def break_at_increase(p: Paged, column: str, amount: float | None = None, name: str = "Part", decrease: bool = False) -> Paged:
    x = F.col(column).cast("double")
    step = (F.lag(x).over(p.over()) - x) if decrease else (x - F.lag(x).over(p.over()))
    return _broken(p, step > 0 if amount is None else step >= amount, name)


def break_at_change(p: Paged, column: str, amount: float | None = None, base: float | None = None, name: str = "Part") -> Paged:
    """Where the value changes; with amount, where trunc((x - base) / amount) does. base: by default the first row's."""
    x = F.col(column)
    if amount is not None:
        start = F.lit(base) if base is not None else F.first(x).over(p.over().rowsBetween(Window.unboundedPreceding, 0))
        r = (x.cast("double") - start) / amount
        region = F.when(r < 0, F.ceil(r)).otherwise(F.floor(r))
        rows = p.rows.withColumn("__region", region)
        out = _broken(p.with_rows(rows), F.col("__region") != F.lag("__region").over(p.over()), name)
        return out.with_rows(out.rows.drop("__region"))
    return _broken(p, ~x.eqNullSafe(F.lag(x).over(p.over())) & (F.row_number().over(p.over()) > 1), name)


def break_at_match(p: Paged, condition: Column, name: str = "Part") -> Paged:
    return _broken(p, condition & (F.row_number().over(p.over()) > 1), name)


def break_by_rows(p: Paged, limit: int, overlap: int = 0, name: str = "Part") -> Paged:
    """Pages of limit rows that start limit - overlap apart, until one reaches the last row."""
    step = limit - overlap
    q = p.numbered().counted()
    pages = F.when(F.col("__rows") <= limit, F.lit(1)).otherwise(F.ceil((F.col("__rows") - limit) / step) + 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("__row") - limit + 1) / step)).cast("int")
    last = F.least(F.floor(F.col("__row") / step), pages - 1).cast("int")
    rows = q.rows.withColumn(name, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))).drop("__row", "__rows")
    return Paged(rows, (*p.page, name), p.order)


def break_in_pieces(p: Paged, pieces: int, name: str = "Part") -> Paged:
    q = p.numbered().counted()
    return Paged(q.rows.withColumn(name, F.floor(F.col("__row") * pieces / F.col("__rows")).cast("int")).drop("__row", "__rows"), (*p.page, name), p.order)


def regroup(p: Paged, name: str = "NewPage") -> Paged:
    """Row i of every page becomes page i; the old page columns order its rows. Pages must be of one length."""
    q = p.numbered(name).counted()
    most = F.max("__rows").over(Window.partitionBy(name))
    same = F.when(F.col("__rows") == most, F.col(name)).otherwise(F.raise_error(F.lit("pages differ in length")).cast("int"))
    return Paged(q.rows.withColumn(name, same).drop("__rows"), (name,), p.page)


def collapse(p: Paged) -> DataFrame:
    """Parameters as rows, with PageNumber from 1 in the order of the page columns."""
    return p.params.withColumn("PageNumber", F.row_number().over(Window.orderBy(*p.page)))  # one row per page


def expand(p: Paged, name: str = "PageNumber") -> Paged:
    """Each row becomes a page whose parameters are the row's columns."""
    numbered = p.rows.withColumn(name, F.row_number().over(Window.partitionBy(*p.page).orderBy(*p.order)))
    keys = (*p.page, name)
    return Paged(numbered.limit(0).select(*keys), keys, (), numbered)


def separate(df: DataFrame, groups: dict[str, list[str]], copy: list[str] = ()) -> DataFrame:
    """Column groups become successive pages: member i of each group is row set i, under the group's name."""
    n = len(next(iter(groups.values())))
    parts = F.array(*[F.struct(F.lit(i).alias("Page"), *[F.lit(members[i]).alias(f"{g}Name") for g, members in groups.items()], *[F.col(members[i]).cast("double").alias(g) for g, members in groups.items()]) for i in range(n)])
    return df.select(*copy, F.explode(parts).alias("__p")).select(*copy, "__p.*")


def collect(df: DataFrame, suffix: str, keys: list[str]) -> DataFrame:
    """Columns `<root><suffix>` become rows Rootname, <suffix>."""
    members = [c for c in df.columns if c.endswith(suffix) and c != suffix]
    return df.select(*keys, *members).unpivot(keys, members, "Rootname", suffix).withColumn("Rootname", F.regexp_replace("Rootname", f"{suffix}$", ""))


def transpose(df: DataFrame, names: str, columns: list[str], most: int = 10_000) -> DataFrame:
    """Numeric columns become rows (OldColumnNames); the names column's values become columns. A matrix: its columns
    are as many as names has values, which is refused beyond `most`."""
    values = [r[0] for r in df.select(names).distinct().orderBy(names).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"over {most} columns")
    long = df.unpivot([names], columns, "OldColumnNames", "__v")
    return long.groupBy("OldColumnNames").pivot(names, values).agg(F.first("__v"))


def matrix_to_column(df: DataFrame, row_name: str, columns: list[str]) -> DataFrame:
    return df.select(row_name, *[F.col(c).cast("double") for c in columns]).unpivot([row_name], columns, "Rootname", "Data")


def array_to_column(df: DataFrame, array: str, keys: list[str], shape: Sequence[int], fixed: dict[int, int] | None = None) -> DataFrame:
    """A flattened array of the given shape, row-major, as rows with one index column per dimension; some may be fixed."""
    out = df.select(*keys, F.posexplode(array).alias("__at", "Value"))
    stride = 1
    strides = []
    for size in reversed(shape):
        strides.insert(0, stride)
        stride *= size
    for d, (size, step) in enumerate(zip(shape, strides, strict=True)):
        index = F.floor(F.col("__at") / step) % size
        out = out.filter(index == fixed[d]) if fixed and d in fixed else out.withColumn(f"Index{d + 1}", index)
    return out.drop("__at")


def alarm_durations(df: DataFrame, names: DataFrame, index: str, key: str, time: str) -> DataFrame:
    """Index-coded log rows with their names, and Duration until the same name's next row."""
    rows = df.join(names, index)
    return rows.withColumn("Duration", F.lead(time).over(Window.partitionBy(key).orderBy(time)) - F.col(time))
