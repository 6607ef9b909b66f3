"""Elements of the order, by brackets, against sorted pages."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.frame import paged
from quire.operators import selection as S

WANTED = {"low": S.percentile(0), "tenth": S.percentile(10), "middle": S.median(), "ninth": S.percentile(90), "high": S.percentile(100)}


def by_sorting(values):
    key = lambda x: (0, 0) if x is None else (2, 0) if math.isnan(x) else (1, x)
    s, n = sorted(values, key=key), len(values)
    return {"low": s[0], "tenth": s[math.floor((n - 1) * 0.1)], "middle": s[n // 2], "ninth": s[math.floor((n - 1) * 0.9)], "high": s[-1]}


def same(a, b):
    return a is None and b is None or a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b)))


def compare(spark, pages, accuracy):
    rows = [(k, None if v is None else float(v)) for k, values in pages.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in S.elements(paged(df, "k"), "v", WANTED, accuracy).collect()}
    assert set(got) == {k for k, v in pages.items() if len(v)}
    for k, values in pages.items():
        if len(values):
            for name, want in by_sorting([None if v is None else float(v) for v in values]).items():
                assert same(got[k][name], want), (k, name, got[k][name], want)


@pytest.mark.parametrize("accuracy", [20, 200, S.ACCURACY])
def test_pages(spark, accuracy):
    r = np.random.default_rng(1)
    odd = [None] * 300 + [float("nan")] * 700 + [float("inf")] * 50 + [float("-inf")] * 50 + r.normal(size=900).tolist()
    pages = {
        "even": r.normal(size=3000), "tails": np.exp(r.normal(size=4000) * 40), "one value": np.full(2500, 7.0), "hot": np.r_[np.full(2000, 1.5), r.normal(size=1000)], "odd": odd,
        "short": [3.0], "two": [2.0, 1.0], "sorted": np.arange(5000.0), None: r.integers(0, 5, 1000).astype(float), "zeros": np.r_[np.full(500, -0.0), np.full(500, 0.0)],
    }
    compare(spark, pages, accuracy)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(width=32), st.integers(-3, 3).map(float)), min_size=1, max_size=300))
def test_any_values(spark, values):
    compare(spark, {"a": values * 3}, 10)


def test_no_rows_and_no_pages(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert S.elements(paged(df, "k"), "v", WANTED).collect() == []
    assert S.elements(paged(spark.range(10)), "id", {"m": S.median()}).collect()[0][0] == 5.0


def test_only_brackets_are_sorted(spark):
    """Rows out of the brackets are added up before the shuffle."""
    df = spark.range(200_000).selectExpr("id % 2 AS k", "CAST(hash(id) AS DOUBLE) AS v")
    out = S.elements(paged(df, "k"), "v", {"m": S.median(), "t": S.percentile(10)}, 1000)
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 1 and "BroadcastHashJoin" in plan
