"""Operator 3, mixing sources to target weights with a time-varying curriculum, in DataFrame functions only.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, ... and share all words; no target exceeds three
times its source. With sources sorted by cap / weight, the level at which the rest share the rest is the largest of
(total - caps before) / (weight - weights before), so one window over the sources replaces repeated resharing.

Curriculum: each source has a weight schedule over training time 0 to 1, piecewise linear between equally spaced
knots. Its integral, scaled to the target, is the source's cumulative demand. A document whose copy starts after c of
the source's demanded words is due where the integral reaches c: inverting a piecewise quadratic. Documents of a source
come in the order of a hash of their id and text, equal ones by a number each, so that many copies of a row or missing
ids do not meet in one place. A target above the size repeats whole passes, and the document that meets the end of the
demand is taken in part (boundary="cut") or as a whole if half of it is due (boundary="whole").

Defined cases: null or blank text has size 0 and is never taken; a null source is the last source; null ids and repeated
rows are documents each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, hex_digits, join_counted, materialize, numbered_copies, running_total, small_side, text_of, whole_row

MAX_PASSES = 3
#: Weights at equally spaced times; the n-th source has schedule n modulo their number.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5), (0.5, 1.5, 0.5))


def inverse_integral(share: str, knots: tuple[float, ...]) -> str:
    """SQL for the time at which the integral of a piecewise linear schedule reaches `share` of its whole."""
    number = lambda x: f"CAST({x!r} AS DOUBLE)"
    n = len(knots) - 1
    areas = [0.0]
    for a, b in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (a + b) / 2 / n)
    cases = []
    for j in range(n):
        past = f"({share} * {number(areas[-1])} - {number(areas[j])})"
        slope, b = (knots[j + 1] - knots[j]) * n / 2, knots[j]
        root = f"sqrt(greatest({number(b * b)} + {number(4 * slope)} * {past}, {number(0.0)}))"
        step = f"coalesce({number(2.0)} * {past} / nullif({number(b)} + {root}, {number(0.0)}), {number(0.0)})"
        value = f"{number(j / n)} + {step}"
        cases.append(f"WHEN {share} * {number(areas[-1])} <= {number(areas[j + 1])} THEN {value}" if j < n - 1 else f"ELSE {value}")
    return f"(CASE {' '.join(cases)} END)" if n > 1 else f"({cases[0].removeprefix('ELSE ')})"


def position_sql(share: str, kind: str, schedules=SCHEDULES) -> str:
    return "(CASE " + " ".join(f"WHEN {kind} = {i} THEN {inverse_integral(share, k)}" for i, k in enumerate(schedules)) + " END)"


def targets(sizes: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """source, source_size, target, schedule; sizes has source and size. One row per source is all that is gathered."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("__rank", rank).withColumn("__weight", 1 + (F.col("__rank") - 1) % 3)
    all_, cap = Window.partitionBy(), MAX_PASSES * F.col("source_size")
    order = Window.orderBy(cap / F.col("__weight"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(all_) - F.coalesce(F.sum(cap).over(order), F.lit(0))
    weights = F.sum("__weight").over(all_) - F.coalesce(F.sum("__weight").over(order), F.lit(0))
    s = s.withColumn("__level", rest / weights).withColumn("__level", F.max("__level").over(all_))
    target = F.least(cap.cast("double"), F.col("__level") * F.col("__weight"))
    return s.select("source", "source_size", target.alias("target"), ((F.col("__rank") - 1) % len(schedules)).alias("schedule"))


def plan(sized: DataFrame, schedules=SCHEDULES, boundary: str = "cut") -> DataFrame:
    """One row per row of `sized` (source, size and order, a unique hex hash; written, as it is read twice): source_size,
    target, and copies: array of (pass, words, position), empty for a document that the mix doesn't take."""
    # the number of rows only picks how many digits of the hash divide them
    digits = hex_digits(sized.count())
    s = targets(sized, schedules).select(F.col("source").alias("__s"), "source_size", "target", "schedule")
    placed = running_total(sized, ["source"], "order", [], "size", "__before", digits)
    placed = placed.join(s, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__demand", F.floor(F.col("target") + 0.5))

    def copy(p):
        start = p * F.col("source_size") + F.col("__before")
        words = F.greatest(F.least(F.col("__demand") - start, F.col("size")), F.lit(0))
        if boundary == "whole":
            words = F.when(2 * words >= F.col("size"), F.col("size")).otherwise(0)
        return F.struct(p.alias("pass"), words.cast("bigint").alias("words"), start.cast("double").alias("start"))

    copies = F.filter(F.transform(F.array(*map(F.lit, range(MAX_PASSES))), copy), lambda c: c["words"] > 0)
    placed = placed.withColumn("__copies", copies)
    at = position_sql("(c.start / __demand)", "schedule", schedules)
    return placed.withColumn("copies", F.expr(f"transform(__copies, c -> struct(c.pass AS pass, c.words AS words, {at} AS position))")).drop("order", "__before", "__s", "__demand", "__copies")


def sized_rows(docs: DataFrame, *more, text: str = "text") -> DataFrame:
    """doc_id, source, size and identity (of id and text) of each document, and more columns."""
    identity = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text_of(text)))
    return docs.select(*more, "doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint").alias("size"), identity.alias("identity"))


def order_of(number) -> Column:
    """The place of a document among those of its source: a uniform hash of its id and text, and of a number that tells
    equal ones apart."""
    return F.md5(F.concat_ws(":", "identity", number.cast("string"))).alias("order")


def curriculum(docs: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position (of the first copy), in order of position."""
    sized = numbered_copies(materialize(sized_rows(docs), "sizes"))  # texts are read once
    sized = materialize(sized.select("doc_id", "source", "size", order_of(F.col("__copy"))), "ordered")
    p = plan(sized, schedules)
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda total, c: total + c["words"])
    return p.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"),
        F.size("copies").alias("copies"), F.get("copies", F.lit(0))["position"].alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """The rows of docs, as often as the mix takes them as whole documents, range-sorted by position."""
    whole = docs.select(whole_row(docs, "__doc"), F.monotonically_increasing_id().alias("__row"))
    whole = materialize(whole, "mix")  # from here on the row number is data, and tells equal rows apart
    same = F.md5(F.concat_ws(":", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")), "identity")).alias("same")
    sized = sized_rows(whole.select("__row", "__doc.doc_id", "__doc.source", "__doc.text"), F.col("__row").alias("row"))
    sized = materialize(sized.select("row", "source", "size", "identity", same), "sizes")
    repeated = materialize(sized.groupBy("same").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeated")
    first = sized.join(repeated.select("same"), "same", "left_anti").select("row", "source", "size", order_of(F.lit(0)))
    again = join_counted(sized, repeated, ["same"], "copies", sized.count()).select("row", "source", "size", order_of(F.col("row")))
    sized = materialize(first.unionByName(again), "ordered")
    slots = plan(sized, schedules, "whole").select("row", F.explode("copies").alias("c")).select("row", F.col("c.position").alias("__position"), F.col("c.pass").alias("__pass"))
    placed = whole.join(small_side(slots), F.col("__row") == F.col("row"))
    return placed.orderBy("__position", "__row", "__pass").select("__doc.*")
