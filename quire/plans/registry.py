"""Collects queries. Doubles are rounded to six decimals on both sides, as sums in another order differ in the last bit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.frame import Paged, paged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def timed(self) -> DataFrame:
        """events with t, seconds since the first of January 2024."""
        return self.events.withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 1e6)

    @property
    def event_pages(self) -> Paged:
        return paged(self.timed, "event_type", ("ts", "event_id"))

    @property
    def order_pages(self) -> Paged:
        return paged(self.orders, "o_orderstatus", "o_orderkey")

    @property
    def customer_pages(self) -> Paged:
        return paged(self.customer, "c_mktsegment", "c_custkey")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_round(F.col(f"`{c}`"), kind, digits).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])


def _round(x: Column, kind: str, digits: int) -> Column:
    """Doubles as DuckDB rounds them: the scaled number, half away from 0. Spark rounds a number's shortest decimals instead,
    which puts some of those near a half on the other side."""
    if kind == "float":
        return F.round(x, digits)
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(x)


#: The same tables for SQL: t(...) is events with seconds, and every SQL query may use it.
TIMED = "t AS (SELECT *, epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6 AS t FROM events)"


def query(sql: str | None = None, name: str | None = None):
    """Register f(tables) under its name; sql may start with its own WITH list after {timed}."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if sql:
            SQL[key] = rounding(sql)
        return f

    return add


def rounding(sql: str) -> str:
    """R(x) stands for round(x, 6)."""
    out, i = [], 0
    while i < len(sql):
        if sql.startswith("R(", i) and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] == "_")):
            depth, j = 1, i + 2
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[j], 0)
                j += 1
            out.append(f"round(({rounding(sql[i + 2 : j - 1])})::DOUBLE, 6)")
            i = j
        else:
            out.append(sql[i])
            i += 1
    return "".join(out)
