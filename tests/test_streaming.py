from pyspark.sql import functions as F

from quire.streaming import pages as S


def run(spark, tmp_path, make, mode, name):
    rows = [(i, f"k{i % 2}", f"2024-01-01 00:{m:02d}:00", float(i)) for i, m in enumerate([0, 1, 2, 3, 20, 21, 40, 41])]
    df = spark.createDataFrame(rows, "i int, k string, t string, v double").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_gap_pages(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: S.gap_pages(s, "t", ["k"], "v", "10 minutes", "0 seconds"), "append", "gaps")
    assert sorted((r["k"], r["vCount"], r["vMean"]) for r in got)[:2] == [("k0", 1, 4.0), ("k0", 2, 1.0)]


def test_windows(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: S.window_statistics(s, "t", [], "v", "10 minutes", "0 seconds"), "append", "windows")
    assert sorted((r["vMin"], r["vMax"]) for r in got)[:2] == [(0.0, 3.0), (4.0, 5.0)]


def test_envelope(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: S.grouped_envelope(s, ["k"], "v"), "complete", "env")
    assert {r["k"]: (r["vSum"], r["vCount"]) for r in got} == {"k0": (12.0, 4), "k1": (16.0, 4)}


def test_row_limit(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: S.row_limit_pages(s, "k", "v", 3), "append", "limits")
    assert sorted((r["k"], r["page"], r["rows"]) for r in got) == [("k0", 0, 3), ("k1", 0, 3)]


def test_log(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 6.0), ("a", 3.0, 7.0)], "c string, t double, v double")
    df.write.parquet(str(tmp_path / "in"))
    q = S.append_log(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"), "c").start()
    q.processAllAvailable()
    q.stop()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert S.log_span(log, "t", 0, 2).count() == 2 and S.log_last(log, "t", 1).first()["v"] == 7
