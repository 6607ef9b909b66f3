"""Row and page selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.frame import Paged
from quire.functions.calendar import text_to_epoch
from quire.functions.wildcard import matches


def inside(column: Column | str, lower, upper) -> Column:
    """Both ends belong to the window; NaN and infinities do not."""
    x = F.col(column) if isinstance(column, str) else column
    return x.between(lower, upper) & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def combine(first: Column, *terms: tuple[str, Column]) -> Column:
    """Fold terms from left to right without precedence; an operator is '&' or '|', with '!' to negate the term."""
    out = first
    for op, term in terms:
        term = ~term if "!" in op else term
        out = out & term if "&" in op else out | term
    return out


def match_rows(df: DataFrame, column: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    return df.filter(matches(F.col(column), pattern, ignore_case))


def time_filter(seconds: Column, after: str | None = None, before: str | None = None, invert: bool = False) -> Column:
    """after <= seconds <= before; the limits are calendar text (yyyy/MM/dd HH:mm:ss)."""
    ok = F.lit(True)
    if after:
        ok = ok & (seconds >= text_to_epoch(F.lit(after)))
    if before:
        ok = ok & (seconds <= text_to_epoch(F.lit(before)))
    return ~ok if invert else ok


def scans_as_number(column: str) -> Column:
    return F.col(column).try_cast("double").isNotNull()


def clip(p: Paged, head: int = 0, tail: int = 0, invert: bool = False) -> Paged:
    """Drop the first head and last tail rows of each page; invert keeps just those."""
    q = p.numbered().counted()
    middle = (F.col("__row") >= head) & (F.col("__row") < F.col("__rows") - tail)
    return p.with_rows(q.rows.filter(~middle if invert else middle).drop("__row", "__rows"))


def clip_fraction(p: Paged, head: float = 0, tail: float = 0, invert: bool = False) -> Paged:
    q = p.numbered().counted()
    middle = (F.col("__row") >= F.floor(F.col("__rows") * head)) & (F.col("__row") < F.col("__rows") - F.floor(F.col("__rows") * tail))
    return p.with_rows(q.rows.filter(~middle if invert else middle).drop("__row", "__rows"))


def sparse(p: Paged, interval: int, offset: int = 0) -> Paged:
    """Rows offset, offset + interval, ... of each page."""
    q = p.numbered()
    return p.with_rows(q.rows.filter((F.col("__row") >= offset) & ((F.col("__row") - offset) % interval == 0)).drop("__row"))


def sample(p: Paged, fraction: float, seed: int = 1) -> Paged:
    """Keep each row with the given chance, decided by a hash of its page and order columns: reruns agree."""
    u = F.pmod(F.xxhash64(F.lit(seed), *p.page, *p.order), F.lit(1 << 30)) / float(1 << 30)
    return p.keep(u < fraction)


def top(p: Paged, n: int, *by: Column) -> Paged:
    """The first n rows of each page in the order given."""
    w = Window.partitionBy(*p.page).orderBy(*by)
    return p.with_rows(p.rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n"))


def page_test(p: Paged, condition: Column, autostop: bool = False, page_order: Sequence[str] = ()) -> Paged:
    """Keep pages whose parameters meet condition; autostop keeps only those before the first that fails."""
    params = p.params.withColumn("__ok", F.coalesce(condition, F.lit(False)))
    if autostop:
        w = Window.orderBy(*(page_order or p.page)).rowsBetween(Window.unboundedPreceding, 0)  # one row per page
        params = params.withColumn("__ok", F.min("__ok").over(w))
    good = params.filter("__ok").drop("__ok")
    return Paged(p.rows.join(good.select(*p.page), list(p.page), "left_semi"), p.page, p.order, good)


def require(p: Paged, columns: Sequence[str] = (), parameters: Sequence[str] = (), absent_columns: Sequence[str] = (), absent_parameters: Sequence[str] = ()) -> Paged:
    """p, if it has what must be there and lacks what must not; else an error that names the first such thing."""
    here = {"column": p.rows.columns, "parameter": p.params.columns if p.params is not None else list(p.page)}
    for kind, names, wanted in (("column", columns, True), ("parameter", parameters, True), ("column", absent_columns, False), ("parameter", absent_parameters, False)):
        for name in names:
            if (name in here[kind]) != wanted:
                raise ValueError(f"{kind} {name} {'does not exist' if wanted else 'exists'}")
    return p
