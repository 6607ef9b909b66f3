"""Work that must grow no faster than the rows: frames that Spark reads anew for each row, and pages that one task would hold."""

import numpy as np
import pandas as pd
import pytest

from quire.frame import paged
from quire.operators import joins, ordered


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("mode", ["last", "next", "interpolate"])
def test_outlier_fills_read_no_frame_to_the_end(spark, mode):
    values = [1.0, 100.0, 3.0, 4.0, 100.0, 6.0, 5.0, 7.0, 100.0]
    p = paged(spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "p int, i int, v double"), "p", "i")
    got = ordered.outliers(p, "v", None, deviation=50.0, mode=mode).rows
    assert "currentrow$(), unboundedfollowing$()" not in plan(got)
    want = {"last": [1, 1, 3, 4, 4, 6, 5, 7, 7], "next": [1, 3, 3, 4, 6, 6, 5, 7, 7], "interpolate": [1, 2, 3, 4, 5, 6, 5, 7, 7]}[mode]
    assert [r["v"] for r in got.orderBy("i").collect()] == want


def test_interpolation_reads_no_frame_to_the_end(spark):
    data = paged(spark.createDataFrame([(float(x), x * 10.0) for x in (0, 1, 4)], "x double, y double"), (), "x")
    at = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 2.0, 2.0, 9.0)], "v double")
    got = joins.interpolate(data, "x", "y", at, "v")
    assert "currentrow$(), unboundedfollowing$()" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [(-1.0, 0.0), (0.0, 0.0), (0.5, 5.0), (2.0, 20.0), (2.0, 20.0), (9.0, 40.0)]


def same_as_sql(spark, folder, name, events):
    """A query and its SQL over events (event_type, microseconds, value)."""
    import duckdb
    from compare import same_rows

    from quire.plans.all_queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    rows = pd.DataFrame(events, columns=["event_type", "us", "value"])
    con.register("rows", rows)
    con.execute(f"""copy (select row_number() over () - 1 as event_id, TIMESTAMP '2024-01-01' + to_microseconds(us::BIGINT) as ts, 1::BIGINT as user_id, event_type, value::DOUBLE as value, '' as props from rows)
        to '{folder}/events.parquet'""")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    same_rows(QUERIES[name](spark, str(folder)), con, SQL[name])


def test_zeros_between_rows_of_one_time(spark, tmp_path):
    same_as_sql(spark, tmp_path, "find_zeros", [("a", 1, 40.0), ("a", 1, 60.0), ("a", 2, 50.0), ("a", 2, 50.0), ("a", 3, 50.0), ("a", 9, 20.0)])


def test_zeros_half_a_microsecond_off_are_rounded_as_in_sql(spark, tmp_path):
    """To the last digit, years after the start: zeros in the middle of an odd number of microseconds."""
    import duckdb

    from quire.plans.all_queries import QUERIES, SQL

    events = [("a", 10**14 + 10**12 * k + 7919 * k + w * (2 * k + 1), 40.0 if (k + w) % 2 else 60.0) for k in range(300) for w in (0, 1)]
    same_as_sql(spark, tmp_path, "find_zeros", events)
    got = sorted(tuple(r) for r in QUERIES["find_zeros"](spark, str(tmp_path)).select("event_type", "t", "value", "valueSlope").collect())
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert got == sorted(con.execute(SQL["find_zeros"]).fetchall())


@pytest.mark.parametrize("tolerance", [0.1, 0.30000000000000004, 5.0, 7.0, 500.0, 1e-3])
def test_tolerance_lookup_against_all_pairs(spark, tolerance):
    """Values on both ends of the tolerance and a last bit off, far ones, nulls, no numbers; the order is against the values."""
    rng = np.random.default_rng(5)
    base = [float(v) for v in np.round(rng.uniform(-3 * tolerance, 3 * tolerance, 30), 4)] + [0.0, -0.0, 1e-17, -1e-17, 1e9 * tolerance, 1e17 * tolerance]
    ends = [v + k * tolerance for v in base for k in (-1, 1)]
    odd = [None, float("nan"), float("inf"), -float("inf")]
    ask = [(i % 3 or None, v) for i, v in enumerate(base + ends + odd)]
    have = [(i % 3 or None, -i, float(v)) for i, v in enumerate(base + [np.nextafter(e, e + s) for e in ends for s in (-1, 0, 1)])] + [(1, 5, v) for v in odd]
    left = paged(spark.createDataFrame([(i, *r) for i, r in enumerate(ask)], "i int, k int, v double"), (), "i")
    right = paged(spark.createDataFrame(have, "g int, o int, u double"), (), "o")
    got = {r["i"]: r["o"] for r in joins.tolerance_lookup(left, right, {"k": "g"}, ("v", "u"), tolerance, ["o"]).collect()}
    near = lambda k, v: [o for g, o, u in have if k is not None and g == k and u is not None and v is not None and abs(v - u) <= tolerance]
    assert got == {i: min(found) for i, (k, v) in enumerate(ask) if (found := near(k, v))}


def test_tolerance_lookup_makes_no_pairs(spark):
    """All of 3,000 values within the tolerance of all of 3,000: 9,000,000 pairs."""
    left = paged(spark.range(3000).selectExpr("id", "id % 2 AS k", "id / 1000 AS v"), (), "id")
    right = paged(spark.range(3000).selectExpr("id AS o", "id % 2 AS g", "id / 1001 AS u"), (), "o")
    got = joins.tolerance_lookup(left, right, {"k": "g"}, ("v", "u"), 500.0, ["o"])
    assert [(r["k"], r["o"]) for r in got.collect()].count((0, 0)) == 1500 == [(r["k"], r["o"]) for r in got.collect()].count((1, 1))
    steps, made = [got._jdf.queryExecution().executedPlan()], []
    while steps:
        p = steps.pop()
        kind = p.nodeName()
        if kind == "AdaptiveSparkPlan" or "QueryStage" in kind:
            steps.append(p.executedPlan() if kind == "AdaptiveSparkPlan" else p.plan())
        steps += [p.children().apply(i) for i in range(p.children().size())]
        made += [p.metrics().apply("numOutputRows").value()] if p.metrics().contains("numOutputRows") else []
    assert made and max(made) < 100_000


def test_peaks_with_a_zone_of_several_rows(spark, tmp_path):
    """Peaks of 25,000 rows, so a zone of 5; few values, so that many are equal, and falling runs, where one settles the next."""
    import random

    rng = random.Random(8)
    events = [("a", i, float(rng.randrange(8))) for i in range(24800)] + [("a", 30000 + i, float(i % 2) * (1000 - i)) for i in range(200)]
    same_as_sql(spark, tmp_path, "peaks_with_exclusion", events)


def test_running_by_value_against_each_window(spark):
    """Ties, gaps, ends of windows on rows and on ends of cells, nulls; no range frame with an end of its own is left."""
    rng = np.random.default_rng(2)
    at = [float(a) for a in rng.integers(-40, 60, 300) * 0.25] + [1000.0, float("nan"), float("nan"), float("inf"), None, None]
    rows = [(i % 2, i, a, None if i % 11 == 0 else float(v)) for i, (a, v) in enumerate(zip(at, rng.normal(1e3, 1, len(at)), strict=True))]
    p = paged(spark.createDataFrame(rows, "p int, i int, t double, v double"), "p", "i")
    for width in (3.0, 0.25, 0.1, 0.0):
        df = ordered.running_by_value(p, "v", "t", width, ["Mean", "Min", "Max", "Sum", "StDev"])
        assert f"{width} following" not in plan(df).lower() and f"currentrow$(), {width}" not in plan(df)
        got = {r["i"]: r for r in df.collect()}
        assert len(got) == len(rows)
        for q, i, t, _ in rows:
            same = lambda u: u is None if t is None else u is not None and (np.isnan(u) if np.isnan(t) else t <= u <= t + width)  # noqa: B023, E731
            v = np.array([w for g, _, u, w in rows if g == q and same(u) and w is not None])
            want = [v.mean(), v.min(), v.max(), v.sum(), v.std(ddof=1) if len(v) > 1 else None] if len(v) else [None] * 5
            have = [got[i]["v" + s] for s in ("Mean", "Min", "Max", "Sum", "StDev")]
            assert [w is None for w in want] == [h is None for h in have], (width, i, t, want, have)
            assert all(w is None or abs(w - h) < 1e-6 for w, h in zip(want, have, strict=True)), (width, i, t, want, have)


@pytest.mark.parametrize("n", [5, 40, 300])
def test_triangles_around_points_are_those_of_all_triangles(n):
    from quire.operators import images

    rng = np.random.default_rng(n)
    a, b, z = rng.uniform(0, 25, n), rng.uniform(-1, 10, n), rng.normal(size=n)
    triangles, hull = images.triangulate(a, b), images._hull(a, b)
    for x, y in rng.uniform((0, -1), (25, 10), (60, 2)):
        want = [z[t] @ w for t in triangles.tolist() if (w := images._weights(a - x, b - y, t)) is not None and (w >= 0).all()]
        got = images.delaunay_triangle(a - x, b - y, hull)
        assert (got is None) == (not want)
        assert got is None or abs(got[1] @ z[list(got[0])] - want[0]) < 1e-9


def test_paged_file_parts_cross_pages_and_pages_cross_parts(spark, tmp_path):
    """Files are the same however the rows were cut into parts; no part is left behind."""
    import os

    from quire.sources import paged_index

    sizes = {"a": 1, "b": 700, "c": 3, "d": 400}
    rows = [(k, i, f"{k}{i}" * (i % 3)) for k, n in sizes.items() for i in range(n)]
    p = paged(spark.createDataFrame(rows, "k string, i bigint, s string").repartition(3), "k", "i")
    found = []
    for size in (50, 1 << 19):
        folder = f"{tmp_path}/{size}"
        paged_index.write_files(p, folder, "ABCD5", 2, part_rows=size)
        names = sorted(os.listdir(folder))
        assert names and all(n.endswith(".paged") or n.endswith(".crc") for n in names)
        files = paged_index.open_files(spark, f"file://{folder}/*.paged")
        back = files.rows().rows.join(files.parameters(), ["__file", "__page"]).select("k", "__row", "i", "s").collect()
        assert sorted(map(tuple, back)) == sorted((k, i, i, s) for k, i, s in rows)
        found.append([open(f"{folder}/{n}", "rb").read() for n in names if n.endswith(".paged")])
    assert found[0] == found[1]


def test_paged_files_are_sorted_in_parts_of_a_page(spark, tmp_path, monkeypatch):
    """One long page of few files: no task that sorts and writes gets much more than a part's rows."""
    from pyspark.sql import functions as F

    from quire.sources import paged_index

    rows = spark.range(30_000, numPartitions=3).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.col("id") * 0.5).alias("x"))
    most, plain = [], type(rows).mapInArrow

    def counted(df, *args):
        most.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return plain(df, *args)

    monkeypatch.setattr(type(rows), "mapInArrow", counted)
    paged_index.write_files(paged(rows, "k", "i"), str(tmp_path), "ABCD5", 2, part_rows=1500)
    assert most[0] < 3 * 1500 and len(most) == 2 and most[1] < 100  # rows to sort; places of pieces
    monkeypatch.undo()
    back = paged_index.open_files(spark, f"file://{tmp_path}/*.paged").rows().rows
    assert back.filter("__row = i AND x = i * 0.5").count() == back.count() == 30_000


def test_last_rows_of_pages_written_in_parts(spark, tmp_path):
    """The last rows of a page may lie in several parts and runs, and a page may have fewer."""
    from pyspark.sql import functions as F

    from quire.sources import paged_index

    sizes = {"a": 7, "b": 1000, "c": 333}
    rows = spark.createDataFrame([(k, i, i * 0.5) for k, n in sizes.items() for i in range(n)], "k string, i bigint, x double").repartition(3)
    paged_index.write_files(paged(rows, "k", "i"), str(tmp_path), "ABCD5", 2, part_rows=15)
    files = paged_index.open_files(spark, f"file://{tmp_path}/*.paged", run=16)
    last = files.rows(["i", "x"], last=20).rows.join(files.parameters(), ["__file", "__page"]).select("k", F.col("__row"), "i", "x").collect()
    assert sorted(map(tuple, last)) == sorted((k, i, i, i * 0.5) for k, n in sizes.items() for i in range(max(0, n - 20), n))


def test_tolerance_lookup_joins_each_value_once(spark):
    left = paged(spark.createDataFrame([(i, i % 2, float(i // 20)) for i in range(400)] + [(400, None, 1.0), (401, 0, None)], "i int, k int, v double"), (), "i")
    right = paged(spark.createDataFrame([(i, i % 2, float(i // 20) + 0.5) for i in range(400)], "j int, r int, w double"), (), "j")
    df = joins.tolerance_lookup(left, right, {"k": "r"}, ("v", "w"), 1.5, ["j"])
    want = {}
    for i in range(400):
        near = [j for j in range(400) if j % 2 == i % 2 and abs(float(i // 20) - float(j // 20) - 0.5) <= 1.5]
        want[i] = min(near)
    assert {r["i"]: r["j"] for r in df.collect()} == want and df.count() == 400
    grouped = [line for line in plan(df).splitlines() if "Aggregate [" in line]
    assert not any("Aggregate [i#" in line for line in grouped)  # left rows, whole, are not grouped


def test_layer_peeling_in_halves_is_peeling_layer_by_layer(spark):
    from quire.operators import signal

    rng = np.random.default_rng(4)
    pages = {0: 0.2 + 0.1 * np.sin(np.arange(3000) / 40) * np.exp(-np.arange(3000) / 300), 1: 0.1 + rng.normal(0, 0.002, 1201), 2: np.array([0.2, 1.16, 0.1, 0.3]), 3: np.array([0.1, 0.2, np.nan, 0.1])}
    pages[4] = np.r_[pages[1][:700], np.nan, pages[1][701:]]
    df = spark.createDataFrame([(p, i, float(x)) for p, v in pages.items() for i, x in enumerate(v)], "p int, i int, v double")
    got = signal.peel_impedance(paged(df, "p", "i"), "v", 1.0).toPandas()
    for p, up in pages.items():
        down, g = np.ones(len(up)), np.zeros(len(up))
        with np.errstate(all="ignore"):
            for k in range(len(g)):
                r = g[k] = up[0]
                down, up = (down - r * up)[:-1] / (1 - r * r), (up - r * down)[1:] / (1 - r * r)
            want = 50 * np.cumprod((1 + g) / (1 - g))
        have = got[got["p"] == p].sort_values("Row")["PeeledImpedance"].to_numpy()
        assert np.array_equal(np.isfinite(want), np.isfinite(have)), p
        ok = np.isfinite(want)
        assert np.allclose(have[ok], want[ok], rtol=1e-9), p
    assert hasattr(signal, "_peeled")  # the loop over all layers took the square of a page's rows


@pytest.mark.parametrize("few", [3, 1 << 16])
def test_descendants_make_the_edges_once_and_join_few_nodes(spark, monkeypatch, few):
    """Levels are broadcast up to `few` nodes and shuffled beyond; the edges' rows are made once, not at each level."""
    monkeypatch.setattr(joins, "FEW", few)
    pairs = [(p, 2 * p + k) for p in range(40) for k in (0, 1)] + [(5, 2), (77, 0)]
    made = spark.sparkContext.accumulator(0)

    def counted(pair):
        made.add(1)
        return pair

    edges = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 3).map(counted), "p bigint, c bigint")
    got = {tuple(r) for r in joins.descendants(edges, spark.createDataFrame([(0,), (1,)], "r bigint"), "p", "c").collect()}
    want, level = set(), {(0, 0), (1, 1)}
    k = 0
    while level:
        want |= {(r, n, k) for r, n in level}
        held = {(r, n) for r, n, _ in want}
        level, k = {(r, c) for r, n in level for p, c in pairs if p == n} - held, k + 1
    assert got == want
    assert made.value == len(pairs)


@pytest.mark.parametrize("n", [240, 241, 2 * 127])
def test_transforms_in_parts_are_those_of_whole_pages(spark, n):
    """Sizes with factors, a prime, and twice a prime; no task is given a page, of which some are short."""
    from quire.operators import signal

    rng = np.random.default_rng(n)
    rows = [(p, i, i * 0.25, float(x)) for p, m in ((0, n), (None, n), (2, 7)) for i, x in enumerate(rng.normal(size=m))]
    p = paged(spark.createDataFrame(rows, "p int, i int, t double, v double"), "p", "i")
    for options in ({"full": True, "subtract_mean": False, "row": "i"}, {"psd": True, "window": "hanning"}, {"pad": True, "full": True}):
        frames = [signal.fft(p, "t", "v", **options, whole=most) for most in (64, 1 << 20)]
        assert frames[0].dtypes == frames[1].dtypes
        got, want = (df.toPandas().sort_values(["p", "f"]).reset_index(drop=True) for df in frames)
        for c in want.columns:
            x, y = got[c].to_numpy(float), want[c].to_numpy(float)
            if c.startswith("Arg"):
                x, y = (np.exp(1j * np.radians(a)) * np.minimum(want["FFTv"] * 1e6, 1) for a in (x, y))
            assert np.allclose(x, y, atol=1e-9, equal_nan=True), (options, c)
        if "row" in options:
            z = paged(frames[1].filter("p IS NULL OR p = 0"), "p", "f")
            for row in ("i", None):
                back = signal.inverse_fft(z, "RealFFTv", "ImagFFTv", n, row=row, whole=64).toPandas().sort_values(["p", "Row"])
                assert np.allclose(back["value"].to_numpy(), [v for q in (0, None) for k, _, _, v in rows if k == q], atol=1e-9)
                assert back["Row"].tolist() == [*range(n)] * 2
