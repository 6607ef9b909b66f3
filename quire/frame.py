"""Paged tables: rows whose page and place inside it are explicit columns.

A page is one value of the page columns; the order columns sort the rows of a page and are unique there. Scalars of a
page (parameters) are a second frame with one row per page. Nothing depends on the order in which rows are stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: What a running or envelope statistic of no values is in compatibility mode.
EMPTY_VALUE = 1.7976931348623157e308


@dataclass(frozen=True)
class Paged:
    rows: DataFrame
    page: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    params: DataFrame | None = None

    def over(self) -> WindowSpec:
        """Rows of a page in order."""
        return Window.partitionBy(*self.page).orderBy(*self.order)

    def back(self) -> WindowSpec:
        """Rows of a page from the last to the first. What follows a row is the part before it here: a frame that ends at
        the row grows with it, while Spark reads one from the row to the page's end anew for each row."""
        return Window.partitionBy(*self.page).orderBy(*[F.col(c).desc() for c in self.order])

    def whole(self) -> WindowSpec:
        """All rows of a page."""
        return Window.partitionBy(*self.page)

    def with_rows(self, rows: DataFrame) -> Paged:
        return replace(self, rows=rows)

    def numbered(self, name: str = "__row") -> Paged:
        """Rows numbered from 0 in each page."""
        return self.with_rows(self.rows.withColumn(name, F.row_number().over(self.over()) - 1))

    def counted(self, name: str = "__rows") -> Paged:
        return self.with_rows(self.rows.withColumn(name, F.count(F.lit(1)).over(self.whole())))

    def keep(self, condition: Column) -> Paged:
        return self.with_rows(self.rows.filter(condition))

    def reduce(self, *aggregates: Column) -> DataFrame:
        """One row per page; pages of params without rows stay, with nulls."""
        out = self.rows.groupBy(*self.page).agg(*aggregates)
        if self.params is not None and self.page:
            return self.params.select(*self.page).join(out, list(self.page), "left")
        return out


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r as an aggregate; 0 if either side is constant (the built-in one fails there in ANSI mode). a and b
    must be null in the same rows."""
    return F.coalesce(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)), F.lit(0.0))


def paged(rows: DataFrame, page: Sequence[str] | str = (), order: Sequence[str] | str = (), params: DataFrame | None = None) -> Paged:
    as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
    return Paged(rows, as_tuple(page), as_tuple(order), params)
