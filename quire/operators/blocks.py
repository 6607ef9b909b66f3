"""Long pages in blocks: operators that look a bounded number of rows back or ahead run on blocks of a page instead of the
whole page, so that a page of any length is many tasks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.frame import Paged
from quire.sources.shared import shared_folder

#: Parts of a page in which rows are numbered first.
CHUNKS = 64


def _place(df: DataFrame, column: str) -> Column:
    """A number in the order of the column: null before, NaN after all others."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp":
        number = F.unix_micros(column)
    elif kind in ("timestamp_ntz", "date"):
        number = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', CAST(`{column}` AS TIMESTAMP_NTZ))")
    elif kind in ("string", "binary", "boolean"):
        raise ValueError(f"{column!r} orders the page and is not a number or time")
    else:
        number = F.col(column)
    number = F.coalesce(number.cast("double"), F.lit(float("-inf")))
    return F.when(F.isnan(number), F.lit(float("inf"))).otherwise(number)


def _same(keys: tuple[str, ...], prefix: str) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)], F.lit(True))


def numbered_in_chunks(p: Paged, name: str = "__row") -> Paged:
    """Rows numbered from 0 in each page, as by Paged.numbered, without a page in one task. A page is cut at quantiles of
    its first order column (a number or time; rows of one value stay together); a row's number is that in its part plus the
    sizes of the parts before. The cuts, CHUNKS numbers a page, are approximate, so they are written before use: both
    passes must see the same ones."""
    keyed = p.rows.withColumn("__v", _place(p.rows, p.order[0]))
    keys = [F.col(k).alias(f"__p{i}") for i, k in enumerate(p.page)]
    cuts = keyed.groupBy(*keys).agg(F.percentile_approx("__v", [k / CHUNKS for k in range(1, CHUNKS)]).alias("__cuts"))
    folder = shared_folder(p.rows.sparkSession, "cuts")
    cuts.write.mode("overwrite").parquet(folder)
    cuts = p.rows.sparkSession.read.parquet(folder)
    rows = keyed.join(cuts, _same(p.page, "__p"), "left").withColumn("__chunk", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))))
    rows = rows.drop("__v", "__cuts", *[f"__p{i}" for i in range(len(p.page))])
    parts = [F.col(k).alias(f"__q{i}") for i, k in enumerate((*p.page, "__chunk"))]
    sizes = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy(*[f"__q{i}" for i in range(len(p.page))]).orderBy(f"__q{len(p.page)}").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")  # CHUNKS rows a page
    inside = F.row_number().over(Window.partitionBy(*p.page, "__chunk").orderBy(*p.order)) - 1
    rows = rows.withColumn("__inside", inside).join(sizes, _same((*p.page, "__chunk"), "__q"), "left")
    rows = rows.withColumn(name, F.col("__before") + F.col("__inside"))
    return p.with_rows(rows.drop("__chunk", "__inside", "__before", *[f"__q{i}" for i in range(len(p.page) + 1)]))


def in_blocks(p: Paged, f: Callable[[Paged], Paged], halo: int, block: int = 1 << 20) -> Paged:
    """f(p), for an f whose result in a row depends on at most `halo` rows before and after it: each block of `block` rows
    is given to f as a page of its own with `halo` rows of its neighbours on both sides, whose results are dropped.

    f must keep the other columns of its rows. A page's first and last rows see its ends, as in f(p). p's rows are read
    three times: for the cuts, for the sizes of parts and for the blocks.
    """
    return p.with_rows(_blocked(p, f, halo, block).drop("__block"))


def _blocked(p: Paged, f: Callable[[Paged], Paged], halo: int, block: int) -> DataFrame:
    """Rows of in_blocks, with the number of their block."""
    if not 0 <= halo <= block:
        raise ValueError("the halo is larger than a block")
    row = F.col("__at")
    blocks = F.array_distinct(F.transform(F.array(row - halo, row, row + halo), lambda r: F.floor(F.greatest(r, F.lit(0)) / block)))
    rows = numbered_in_chunks(p, "__at").rows.withColumn("__own", F.floor(row / block)).withColumn("__block", F.explode(blocks)).drop("__at")
    done = f(Paged(rows, (*p.page, "__block"), p.order))
    return done.rows.filter("__own = __block").drop("__own")


def cumulative_integral(p: Paged, y: str, x: str, name: str, block: int = 1 << 20) -> Paged:
    """Running sum of trapezoids from 0, as ordered.cumulative_integral: within blocks, plus the sums of earlier blocks."""

    def within(q: Paged) -> Paged:
        a, b, o = F.col(x).cast("double"), F.col(y).cast("double"), q.over()
        step = F.when(F.col("__own") == F.col("__block"), (b + F.lag(b).over(o)) * (a - F.lag(a).over(o)) / 2)  # not of the neighbours' rows
        rows = q.rows.withColumn("__a", F.coalesce(step, F.lit(0.0)))
        return q.with_rows(rows.withColumn("__sum", F.sum("__a").over(o.rowsBetween(Window.unboundedPreceding, 0))))

    rows = _blocked(p, within, 1, block)
    keys = (*p.page, "__block")
    sums = rows.groupBy(*[F.col(k).alias(f"__b{i}") for i, k in enumerate(keys)]).agg(F.sum("__a").alias("__all"))
    earlier = Window.partitionBy(*[f"__b{i}" for i in range(len(p.page))]).orderBy(f"__b{len(p.page)}").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__all").over(earlier), F.lit(0.0)))  # a row per block
    rows = rows.join(sums, _same(keys, "__b"), "left").withColumn(name, F.col("__before") + F.col("__sum"))
    return p.with_rows(rows.drop("__a", "__sum", "__all", "__before", "__block", *[f"__b{i}" for i in range(len(keys))]))
