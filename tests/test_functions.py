import math

import pytest
from pyspark.sql import functions as F

from quire.functions import calendar
from quire.functions.editing import edit, parse
from quire.functions.expression import Compiler, ExpressionError, infix
from quire.functions.wildcard import expand_ranges, select_names, to_regex


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(("pattern", "text", "ok"), [("a*", "abc", True), ("a?c", "abc", True), ("a?c", "abbc", False), ("[ab]x", "bx", True), ("[^ab]x", "bx", False), ("^a*", "abc", False), (r"a\*", "a*", True), (r"a\*", "ab", False), ("a.c", "abc", False), ("", "", True)])
def test_wildcards(spark, pattern, text, ok):
    from quire.functions.wildcard import matches

    assert value(spark, matches(F.lit(text), pattern)) is ok
    assert select_names([text], pattern) == ([text] if ok else [])


def test_ranges():
    assert expand_ranges("x[a-d1-3]") == "x[abcd123]"
    assert to_regex("^*")[1]


@pytest.mark.parametrize(("text", "want"), [("1 2 +", 3), ("7 2 /", 3.5), ("1 0 /", math.inf), ("2.5 round", 3), ("-2.7 int", -2), ("3 sqr 1 +", 10), ("5 = *", 25), ("1 2 swap -", 1), ("7 3 fmod", 1), ("3 2 > ? pop pop 10 : pop pop 20 $", 10), ("4 sto q pop q q *", 16), ('"abc" strlen', 3), ("5 3 bit&", 1)])
def test_stack_expressions(spark, text, want):
    assert value(spark, Compiler({}).number(text)) == want


@pytest.mark.parametrize(("text", "want"), [("1 + 2 * 3", 7), ("2 ^ 3 ^ 2", 512), ("-(1 + 2)", -3), ("1 > 2 ? 5 : 6", 6), ("sqrt(16) + max2(1, 2)", 6), ("3 - 2 - 1", 0), ("1 == 1 && !(2 > 3) ? 1 : 0", 1)])
def test_infix(spark, text, want):
    assert value(spark, infix(text, {})) == want


def test_refused_and_malformed():
    for bad in ("csh", "x", "+", "1 ? 2 : 3 $", "1 2 > ? 3"):
        with pytest.raises(ExpressionError):
            Compiler({}).number(bad)
    with pytest.raises(ExpressionError):
        Compiler({}, {"loop": "loop"}).number("loop")
    for bad in ("1 +", "(1", "f(1)", "1 2"):
        with pytest.raises(ExpressionError):
            infix(bad, {})


def test_editing():
    assert edit("hello world", parse("5fi,/,x/"[:2] + "i/,/")) == "hello, world"
    assert edit("abcabc", parse("%/b/X/")) == "aXcabc"
    assert edit("abcabc", parse("%g/b/X/")) == "aXcaXc"
    assert edit("abc", parse("eK")) == "abc"
    assert edit("abc", parse("2kei/-/y")) == "c-ab"
    assert edit("hello", parse("s/l/K")) == "he"


def test_calendar(spark):
    parts = calendar.breakdown(F.lit(951782400.0 + 3723.5))  # 29 February 2000
    row = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert (row["Year"], row["Month"], row["Day"], row["JulianDay"], row["Text"]) == (2000, 2, 29, 60, "2000/02/29 01:02:03")
    assert abs(row["Hour"] - 3723.5 / 3600) < 1e-9
    assert value(spark, calendar.epoch(F.lit(2000), F.lit(2), F.lit(29), F.lit(1.0))) == 951782400.0 + 3600
    assert value(spark, calendar.epoch_of_julian(F.lit(2000), F.lit(60), F.lit(0.0))) == 951782400.0
    assert value(spark, calendar.breakdown(F.lit(-1.0))["Text"]) == "1969/12/31 23:59:59"
