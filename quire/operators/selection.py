"""Exact elements of the ascending order of a page's values, without sorting the page.

A first pass makes a mergeable rank sketch of each page. Its rank error is bounded, so two of its quantiles bracket each
wanted element for certain. A second pass adds up, before the shuffle, how many rows lie under each bracket and how often
each value inside occurs; only the distinct values inside, one in accuracy / 4 of the rows at most, are put in order. Both
passes keep no more than the sketch of a page in a task. Pages of up to 4 * accuracy rows are one bracket.

Defined cases: nulls come first, then minus infinity, numbers, infinity and NaN; equal values count as often as they
occur, however many they are; pages without rows give no row; a null page is a page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.frame import Paged
from quire.sources.shared import shared_folder

ACCURACY = 1 << 14
INFINITY = float("inf")

#: Of a page of n rows, the place k of the element, counted from 0, and its share of the rows.
Element = tuple[Callable[[Column], Column], float]


def percentile(p: float) -> Element:
    return lambda n: F.floor((n - 1) * (p / 100)), p / 100


def median() -> Element:
    return lambda n: F.floor(n / 2), 0.5


def elements(p: Paged, column: str, wanted: dict[str, Element], accuracy: int = ACCURACY) -> DataFrame:
    """A row for each page with the wanted elements of the column's values as doubles."""
    page = list(p.page)
    x = F.col(column).cast("double")
    place = F.when(x.isNull(), -INFINITY).when(F.isnan(x), INFINITY).otherwise(x)  # as x sorts, but for ties at the ends
    rows = p.rows.select(*page, x.alias("__x"), place.alias("__y"))
    at = [min(1.0, max(0.0, share + side * 2 / accuracy)) for _, share in wanted.values() for side in (-1, 1)]
    sketch = rows.groupBy(*page).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__y", at, accuracy).alias("__q"))

    def bracket(i: int, of: Element) -> Column:
        long, share = F.col("__n") > 4 * accuracy, of[1]
        low = F.when(long & F.lit(share > 2 / accuracy), F.col("__q")[2 * i]).otherwise(-INFINITY)
        high = F.when(long & F.lit(share < 1 - 2 / accuracy), F.col("__q")[2 * i + 1]).otherwise(INFINITY)
        return F.struct(low.alias("low"), high.alias("high"), of[0](F.col("__n")).cast("bigint").alias("k"))

    folder = shared_folder(p.rows.sparkSession, "brackets")
    brackets = sketch.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(page)], F.array(*[bracket(i, w) for i, w in enumerate(wanted.values())]).alias("__b"))
    brackets.write.parquet(folder)  # one row a page: Catalyst broadcasts it if the file is small, as it then knows
    brackets = p.rows.sparkSession.read.parquet(folder)

    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(page)], F.lit(True))
    side = lambda b: F.when(F.col("__y") < b["low"], -1).when(F.col("__y") > b["high"], 1).otherwise(0)
    held = rows.join(brackets, same).select(*page, "__x", F.transform("__b", side).alias("__side"), F.transform("__b", lambda b: b["k"]).alias("__k"))
    held = held.withColumn("__x", F.when(F.array_contains("__side", 0), F.col("__x")))
    counted = held.groupBy(*page, "__side", "__x", "__k").agg(F.count(F.lit(1)).alias("__c"))
    each = counted.select(*page, "__x", "__c", F.posexplode(F.arrays_zip("__side", "__k")).alias("__i", "__t"))
    each = each.filter("__t.__side <= 0").groupBy(*page, "__i", F.col("__t.__k").alias("__k"), F.col("__t.__side").alias("__side"), F.when(F.col("__t.__side") == 0, F.col("__x")).alias("__x")).agg(F.sum("__c").alias("__c"))
    until = F.sum("__c").over(Window.partitionBy(*page, "__i").orderBy("__side", "__x"))
    hit = F.when((F.col("__side") == 0) & (F.col("__k") < F.col("__until")) & (F.col("__k") >= F.col("__until") - F.col("__c")), F.col("__i"))
    found = each.withColumn("__until", until).withColumn("__hit", hit)
    missed = F.raise_error(F.lit("an element lies outside of its bracket")).cast("double")
    value = lambda i: F.when(F.count(F.when(F.col("__hit") == i, 1)) == 1, F.max(F.when(F.col("__hit") == i, F.col("__x")))).otherwise(missed)
    return found.groupBy(*page).agg(*[value(i).alias(name) for i, name in enumerate(wanted)])


def with_page_values(p: Paged, values: DataFrame) -> DataFrame:
    """p's rows with the columns of values, a row for each page."""
    named = values.withColumnsRenamed({c: f"__p{i}" for i, c in enumerate(p.page)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(p.page)], F.lit(True))
    return p.rows.join(named, same).drop(*[f"__p{i}" for i in range(len(p.page))])
