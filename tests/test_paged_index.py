"""Paged files by their index, against the reader of whole files."""

import pytest
from pyspark.sql import functions as F

from quire.frame import paged
from quire.sources import paged_file as P
from quire.sources import paged_index as I

COLUMNS = [{"name": "x", "type": "double"}, {"name": "label", "type": "string"}, {"name": "n", "type": "long64"}, {"name": "c", "type": "character"}, {"name": "u", "type": "ulong64"}]
PAGES = [{"parameters": {"run": k, "title": f"page {k}"}, "arrays": {"grid": ([2, 1], [5, 6])}, "rows": [[i / 3, f'a "{i}" é' * (i % 3), (1 << 40) + i, "xyz"[i % 3], (1 << 64) - 1 - i] for i in range(n)]} for k, n in enumerate([7, 0, 1, 23], 1)]
KINDS = [{"mode": "binary"}, {"mode": "binary", "column_major_order": "1"}, {"mode": "ascii"}]


def layout(data, fixed=False, big=False):
    columns = [c for c in COLUMNS if not fixed or c["type"] != "string"]
    lay = P.Layout(columns, [{"name": "run", "type": "long"}, {"name": "title", "type": "string"}], [{"name": "grid", "type": "short", "dimensions": "2"}], dict(data))
    lay.big_endian = big
    return lay


def saved(folder, data, fixed=False, big=False, name="a.paged"):
    pages = [p | {"rows": [[x for x, c in zip(r, COLUMNS, strict=True) if not fixed or c["type"] != "string"] for r in p["rows"]]} for p in PAGES]
    (folder / name).write_bytes(P.write_bytes("ABCD5", layout(data, fixed, big), pages))
    return pages


@pytest.mark.parametrize("data", KINDS)
@pytest.mark.parametrize("fixed", [False, True])
@pytest.mark.parametrize("big", [False, True])
def test_same_rows_in_short_runs(spark, tmp_path, data, fixed, big):
    pages = saved(tmp_path, data, fixed, big and data["mode"] == "binary")
    files = I.open_files(spark, f"file://{tmp_path}/*.paged", run=5)
    assert files.index.count() == 2 + 1 + 1 + 5
    p = files.rows()
    got = [list(r)[2:] for r in p.rows.drop("__file").orderBy("__page", "__row").collect()]
    assert [[int(x) if type(x).__name__ == "Decimal" else x for x in r] for r in got] == [r for q in pages for r in q["rows"]]
    assert [tuple(r) for r in files.parameters().orderBy("__page").select("__page", "__rows", "run", "title").collect()] == [(k, n, k, f"page {k}") for k, n in enumerate([7, 0, 1, 23], 1)]


@pytest.mark.parametrize("data", KINDS)
def test_parts(spark, tmp_path, data):
    saved(tmp_path, data)
    files = I.open_files(spark, f"file://{tmp_path}/*.paged", run=4)
    rows = lambda *a, **k: sorted((r["__page"], r["__row"]) for r in files.rows(*a, **k).rows.collect())
    every = [(k, i) for k, n in enumerate([7, 0, 1, 23], 1) for i in range(n)]
    assert rows(["n"], every=3, offset=2) == [(k, i) for k, i in every if i % 3 == 2]
    assert rows(["n"], every=10, offset=6) == [(1, 6), (4, 6), (4, 16)]
    assert rows(last=5) == [(1, i) for i in range(2, 7)] + [(3, 0)] + [(4, i) for i in range(18, 23)]
    assert rows(["c", "x"], where=F.col("run") >= 3) == [(k, i) for k, i in every if k >= 3]
    assert rows(["c"], where=F.col("__page") == 2) == [] and rows(last=0) == []
    assert files.rows(["n", "x"]).rows.columns == ["__file", "__page", "__row", "n", "x"]
    assert files.rows(["n"]).rows.rdd.getNumPartitions() > 1  # one file, several tasks


@pytest.mark.parametrize("data", KINDS)
def test_cut_file(spark, tmp_path, data):
    saved(tmp_path, data)
    raw = (tmp_path / "a.paged").read_bytes()
    (tmp_path / "a.paged").write_bytes(raw[: len(raw) - len(raw) // 10])
    with pytest.raises(Exception, match="ends inside|unpack|buffer"):
        I.open_files(spark, f"file://{tmp_path}/*.paged").rows().rows.collect()
    kept = I.open_files(spark, f"file://{tmp_path}/*.paged", whole=False, run=4)
    assert sorted({r["__page"] for r in kept.rows(["n"]).rows.collect()}) == [1, 3]


def test_other_columns_and_no_files(spark, tmp_path):
    with pytest.raises(Exception, match="no files|PATH_NOT_FOUND|does not exist"):
        I.open_files(spark, f"file://{tmp_path}/*.paged")
    saved(tmp_path, KINDS[0])
    saved(tmp_path, KINDS[0], fixed=True, name="b.paged")
    with pytest.raises(Exception, match="other columns"):
        I.open_files(spark, f"file://{tmp_path}/*.paged")


def test_without_row_counts(spark, tmp_path):
    (tmp_path / "t.paged").write_text("ABCD5\n&column name=a, type=long, &end\n&column name=b, type=string, &end\n&data mode=ascii, no_row_counts=1, &end\n! note\n1 x\n2 \"y z\"\n! note\n3 w\n\n4 v\n")
    got = I.open_files(spark, f"file://{tmp_path}/*.paged", run=2).rows().rows.drop("__file").orderBy("__page", "__row").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, "x"), (1, 1, 2, "y z"), (1, 2, 3, "w"), (2, 0, 4, "v")]


def test_written_by_tasks(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.concat(F.lit("p"), F.col("id") % 2).alias("h"), F.col("id").alias("i"), (F.col("id") / 7).alias("x"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("ü"), "id")).alias("s"))
    I.write_files(paged(rows, ("k", "h"), "i"), f"file://{tmp_path}/out", "ABCD5", files=3)
    files = I.open_files(spark, f"file://{tmp_path}/out/*.paged", run=16)
    p = files.rows().rows.join(files.parameters(), ["__file", "__page"])
    assert files.parameters().count() == 14
    want = rows.withColumn("s", F.coalesce("s", F.lit("")))
    assert p.select("k", "h", "i", "x", "s").exceptAll(want.select("k", "h", "i", "x", "s")).count() == 0 and p.count() == 1000
    assert p.filter("i != (__row * 7 + k % 7) AND i != __row * 14 + i % 14").count() == 0  # in order
    I.write_files(paged(rows.select("k", "i", "x"), "k", "i"), f"file://{tmp_path}/fixed", "ABCD5", files=2)
    assert I.open_files(spark, f"file://{tmp_path}/fixed/*.paged").rows().rows.agg(F.sum("i")).first()[0] == 499500
    with pytest.raises(Exception, match="null"):
        I.write_files(paged(rows.withColumn("x", F.lit(None).cast("double")), "k", "i"), f"file://{tmp_path}/null", "ABCD5")
