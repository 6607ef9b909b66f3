"""Rows made from sequences and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.expression import Compiler


def sequences(spark: SparkSession, columns: dict[str, tuple[float, float, float]], repeat: int = 1) -> DataFrame:
    """Columns of arithmetic sequences (begin, end, delta) of one length, repeat times: page, row and the columns."""
    counts = {c: int((e - b) / d + 1.5) for c, (b, e, d) in columns.items()}
    n = max(counts.values())
    if min(counts.values()) != n:
        raise ValueError(f"sequences differ in length: {counts}")
    rows = spark.range(n * repeat).select(F.floor(F.col("id") / n).alias("page"), (F.col("id") % n).alias("row"))
    return rows.select("page", "row", *[(F.lit(b) + F.col("row") * d).alias(c) for c, (b, _, d) in columns.items()])


def grid(spark: SparkSession, x: str, x_range: tuple[float, float, int], y: str, y_range: tuple[float, float, int], name: str, equation: str) -> DataFrame:
    """name = equation (stack notation) on a grid of nx by ny points."""
    (x0, x1, nx), (y0, y1, ny) = x_range, y_range
    i, j = F.floor(F.col("id") / ny), F.col("id") % ny
    rows = spark.range(nx * ny).select((x0 + i * ((x1 - x0) / (nx - 1))).alias(x), (y0 + j * ((y1 - y0) / (ny - 1))).alias(y))
    return rows.withColumn(name, Compiler({x: F.col(x), y: F.col(y)}).number(equation))


def literal_table(spark: SparkSession, columns: dict[str, list], types: dict[str, str] | None = None) -> DataFrame:
    """Columns given as lists of one length; types default to double."""
    schema = ", ".join(f"`{c}` {(types or {}).get(c, 'double')}" for c in columns)
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def halton(index, base: int, digits: int = 32):
    """The index-th element (from 1) of the Halton sequence of a base, as an expression."""
    total = F.lit(0.0)
    for k in range(digits):
        power = base**k
        if power > 1 << 62:
            break
        total = total + (F.floor(index / power) % base) / float(power * base)
    return total


def sample_distribution(spark: SparkSession, table: DataFrame, x: str, cdf: str, n: int, base: int = 2) -> DataFrame:
    """n values of a tabulated distribution: Halton numbers through the inverse of its cumulative form, which is linear
    between rows. A number looks its interval up by the rows' places in one sorted array of the table, which must be
    small enough for an expression."""
    rows = [(float(a), float(b)) for a, b in table.select(x, cdf).orderBy(cdf, x).limit(100_001).collect()]
    if len(rows) > 100_000:
        raise ValueError("over 100000 rows in a distribution table")
    lo, hi = rows[0][1], rows[-1][1]
    steps = F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1"), F.lit(p).alias("p0"), F.lit(q).alias("p1")) for (a, p), (b, q) in zip(rows, rows[1:], strict=False) if q > p])
    out = spark.range(1, n + 1).select("id", (halton(F.col("id"), base) * (hi - lo) + lo).alias("u"))
    hit = F.get(F.filter(steps, lambda s: (s["p0"] <= F.col("u")) & (F.col("u") < s["p1"])), F.lit(0))
    return out.withColumn("s", hit).select("id", (F.col("s.x0") + (F.col("u") - F.col("s.p0")) * (F.col("s.x1") - F.col("s.x0")) / (F.col("s.p1") - F.col("s.p0"))).alias(x))


def uniform(spark: SparkSession, n: int, low: float, high: float, seed: int = 1) -> DataFrame:
    """n uniform values decided by their number: reruns and retried tasks agree."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 53)) / float(1 << 53)
    return spark.range(n).select("id", (low + (high - low) * u).alias("value"))


def gaussian(spark: SparkSession, n: int, mean: float, sd: float, seed: int = 1) -> DataFrame:
    draw = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), F.col("id")), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return spark.range(n).select("id", (mean + sd * F.sqrt(-2 * F.log(draw(0))) * F.cos(2 * 3.141592653589793 * draw(1))).alias("value"))
