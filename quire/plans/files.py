"""Sources, sinks and the remaining lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.frame import paged
from quire.operators import joins as J
from quire.plans.registry import query
from quire.sources import exports, generate, imports
from quire.sources.shared import shared_folder


@query("SELECT c_mktsegment, c_custkey, printf('%06d', c_custkey) || ';' || c_name || ';' || c_nationkey AS line FROM customer")
def stream_lines(t):
    return exports.lines(t.customer_pages, ["c_custkey", "c_name", "c_nationkey"], ";", {"c_custkey": "%06d"})


@query("""WITH m AS (SELECT 32767 / greatest(max(abs(c_acctbal)), max(abs(c_nationkey * 100 - 1200))) AS m FROM customer) SELECT c_custkey, floor(c_acctbal * m + 0.5)::INT AS "iSample", floor((c_nationkey * 100 - 1200) * m + 0.5)::INT AS "qSample",
printf('%04X', ((floor(c_acctbal * m + 0.5)::INT + 65536) % 65536)) || printf('%04X', ((floor((c_nationkey * 100 - 1200) * m + 0.5)::INT + 65536) % 65536)) AS sample FROM customer, m""")
def waveform_samples(t):
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("I"), (F.col("c_nationkey") * 100 - 1200).cast("double").alias("Q"))
    return exports.iq_samples(rows).select("c_custkey", "iSample", "qSample", F.hex("sample").alias("sample"))


_CELLS = "p AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r, n_nationkey * 1.5::DOUBLE AS a, n_nationkey + 0.25::DOUBLE AS b FROM nation), c AS (SELECT n_regionkey, r, 0 AS y, a AS value FROM p UNION ALL SELECT n_regionkey, r, 1, b FROM p)"


def _field(t):
    p = paged(t.nation, "n_regionkey", "n_nationkey").numbered("r")
    return p.with_rows(p.rows.select("n_regionkey", "r", (F.col("n_nationkey") * 1.5).alias("a"), (F.col("n_nationkey") + 0.25).alias("b")))


@query(f"WITH {_CELLS} SELECT n_regionkey, r, y, value FROM c")
def field_volume(t):
    return exports.field_volume(_field(t), "r", ["a", "b"])


@query(f"WITH {_CELLS} SELECT y, n_regionkey, " + ", ".join(f"max(value) FILTER (WHERE r = {k}) AS x{k}" for k in range(5)) + " FROM c GROUP BY 1, 2")
def field_planes(t):
    return exports.field_planes(_field(t), "r", ["a", "b"], range(5))


@query("""SELECT p_partkey, '| ' || p_name || ' | ' || p_size || ' |' AS line FROM part""")
def report_markdown(t):
    return exports.report(paged(t.part, (), "p_partkey"), ["p_name", "p_size"], "markdown")


@query("""SELECT p_partkey, p_name || ',' || p_type AS line FROM part""")
def report_csv(t):
    return exports.report(paged(t.part, (), "p_partkey"), ["p_name", "p_type"], "csv")


@query("""SELECT p_partkey, CASE WHEN length(p_name) >= 15 THEN ' ' || p_name ELSE lpad(p_name, 15, ' ') END || lpad(p_size::VARCHAR, 15, ' ') AS line FROM part""")
def report_text(t):
    return exports.report(paged(t.part, (), "p_partkey"), ["p_name", "p_size"])


@query("""SELECT p_partkey, '<tr><td>' || p_name || '</td><td>' || p_size || '</td></tr>' AS line FROM part""")
def report_html(t):
    return exports.report(paged(t.part, (), "p_partkey"), ["p_name", "p_size"], "html")


@query("""SELECT s_suppkey, '{"s_suppkey" -> ' || s_suppkey || ', "s_nationkey" -> ' || s_nationkey || '}' AS line FROM supplier""")
def mathematica_rules(t):
    return exports.mathematica(paged(t.supplier, (), "s_suppkey"), ["s_suppkey", "s_nationkey"])


@query("SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, 'y'")
def literal_table(t):
    return generate.literal_table(t.spark, {"a": [1, 2], "b": ["x", "y"]}, {"a": "int", "b": "string"})


@query("""WITH u AS (SELECT i AS id, list_sum(list_transform(range(30), lambda k: ((i // (1 << k)) % 2) / (1 << (k + 1))::DOUBLE)) AS u FROM range(1, 201) r(i))
SELECT id, R(CASE WHEN u < 0.25 THEN u / 0.25 * 2 WHEN u < 0.75 THEN 2 + (u - 0.25) / 0.5 * 3 ELSE 5 + (u - 0.75) / 0.25 * 5 END) AS x FROM u""")
def sample_from_table(t):
    table = generate.literal_table(t.spark, {"x": [0.0, 2.0, 5.0, 10.0], "cdf": [0.0, 0.25, 0.75, 1.0]})
    return generate.sample_distribution(t.spark, table, "x", "cdf", 200)


@query("SELECT 1000 AS n, true AS mean_ok, true AS sd_ok")
def sample_gaussian(t):
    g = generate.gaussian(t.spark, 1000, 5.0, 2.0)
    return g.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("value") - 5) < 0.3).alias("mean_ok"), (F.abs(F.stddev_samp("value") - 2) < 0.3).alias("sd_ok"))


@query("SELECT x, R(pow(x, 3) - 2 * x) AS y FROM (SELECT unnest([0.25, 1.5, 2.75])::DOUBLE AS x)")
def interpolate_cubic(t):
    rows = t.spark.range(9).select((F.col("id") / 2).alias("x")).withColumn("y", F.pow("x", F.lit(3)) - 2 * F.col("x"))
    return J.interpolate_polynomial(paged(rows.withColumn("p", F.lit(0)), "p", "x"), "x", "y", [0.25, 1.5, 2.75], 3).drop("p")


@query("""SELECT 'a' AS "File", 7.0::DOUBLE AS y UNION ALL SELECT 'b', -3.5""")
def interpolate_files(t):
    make = lambda k: paged(t.spark.range(10).select(F.col("id").cast("double").alias("x"), (F.col("id") * k).cast("double").alias("y")), (), "x")
    return J.interpolate_set({"a": make(2), "b": make(-1)}, "x", "y", 3.5)


@query("SELECT x::DOUBLE AS x, R(3 * x * x) AS y FROM (SELECT unnest([1.0, 2.0, 3.0, 4.0]) AS x)")
def interpolate_with_model(t):
    model = t.spark.range(1, 6).select(F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id")).cast("double").alias("y"))
    data = paged(generate.literal_table(t.spark, {"x": [1.0, 5.0], "y": [3.0, 75.0]}), (), "x")
    return J.interpolate_by_model(data, model, "x", "y", generate.literal_table(t.spark, {"v": [1.0, 2.0, 3.0, 4.0]}), "v")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS p, c_custkey * 3 + k AS c FROM customer, (SELECT unnest([1, 2]) AS k)),
d AS (SELECT 0::BIGINT AS root, 0::BIGINT AS node, 0 AS level UNION ALL SELECT root, c, level + 1 FROM d JOIN e ON p = node) SELECT * FROM d""")
def dependency_tree(t):
    e = t.customer.select(F.col("c_custkey").alias("p"), F.explode(F.array(F.col("c_custkey") * 3 + 1, F.col("c_custkey") * 3 + 2)).alias("c"))
    return J.descendants(e, t.spark.range(1), "p", "c")


@query("SELECT count(DISTINCT c_mktsegment) AS pages, count(*) AS rows, 'ok' AS verdict FROM customer")
def write_and_read_files(t):
    """A file a page, through the writer and reader of whole files, in the folder that the workers share (tasks write with
    open(), so it must be a mounted one)."""
    from quire.sources import paged_file

    columns = ["c_custkey", "c_acctbal", "c_name"]
    rows = t.customer.select("c_mktsegment", *columns)
    folder = shared_folder(t.spark).removeprefix("file://")
    paged_file.write(paged(rows, "c_mktsegment", "c_custkey"), folder, "ABCD5").collect()
    back, _ = paged_file.read(t.spark, f"{folder}/*.paged")
    same = back.rows.join(rows.withColumnsRenamed({"c_name": "name", "c_acctbal": "balance"}), "c_custkey").filter("c_acctbal = balance AND c_name = name")
    verdict = paged_file.verdicts(t.spark, f"{folder}/*.paged").agg(F.min("verdict").alias("verdict"))
    return same.agg(F.countDistinct("__file").alias("pages"), F.count(F.lit(1)).alias("rows")).join(verdict, F.lit(True))


def _files(t, rows, page, order, files=2):
    """rows in a few files of many pages each, by their index."""
    from quire.sources import paged_index

    folder = shared_folder(t.spark)
    paged_index.write_files(paged(rows, page, order), folder, "ABCD5", files)
    return paged_index.open_files(t.spark, f"{folder}/*.paged")


def _event_files(t):
    return _files(t, t.timed.select("event_type", "t", "event_id", "value"), "event_type", ("t", "event_id"))


_PLACED = "e AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


def _with_parameters(files, rows, page):
    return rows.rows.join(files.parameters(), ["__file", "__page"]).select(page, F.col("__row").alias("r"), *[c for c in rows.rows.columns if not c.startswith("__")])


@query("SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS r, c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def paged_files_round_trip(t):
    """Texts and numbers of all pages, written as files of many pages and read by runs of rows."""
    files = _files(t, t.customer.select("c_mktsegment", "c_custkey", "c_name", "c_acctbal", "c_nationkey"), "c_mktsegment", "c_custkey")
    return _with_parameters(files, files.rows(), "c_mktsegment")


@query("SELECT o_orderdate::VARCHAR AS day, count(*) AS n FROM orders GROUP BY 1")
def paged_files_index(t):
    """Rows of each of thousands of pages, from the index alone."""
    files = _files(t, t.orders.select(F.col("o_orderdate").cast("string").alias("day"), "o_orderkey", "o_totalprice"), "day", "o_orderkey")
    return files.parameters().select("day", F.col("__rows").alias("n"))


@query(f"WITH {_PLACED} SELECT event_type, r, value FROM e WHERE r % 10 = 3")
def paged_files_sparse(t):
    """One column of every tenth row."""
    files = _event_files(t)
    return _with_parameters(files, files.rows(["value"], every=10, offset=3), "event_type")


@query(f"WITH {_PLACED} SELECT event_type, r, event_id, value FROM e WHERE r >= n - 20")
def paged_files_last_rows(t):
    """The last rows of each page; runs before them are not read."""
    files = _event_files(t)
    return _with_parameters(files, files.rows(["event_id", "value"], last=20), "event_type")


@query(f"WITH {_PLACED} SELECT event_type, r, event_id, value FROM e WHERE event_type >= 'p'")
def paged_files_chosen_pages(t):
    """Pages chosen by a parameter before their data is read."""
    files = _event_files(t)
    return _with_parameters(files, files.rows(["event_id", "value"], where=F.col("event_type") >= "p"), "event_type")


@query("SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def import_delimited(t):
    """A table written as delimited text, with a header line in each file, and read back."""
    folder = shared_folder(t.spark)
    exports.write_lines(exports.lines(paged(t.customer, (), "c_custkey"), ["c_custkey", "c_name", "c_acctbal", "c_nationkey"], ";"), folder)
    return imports.csv(t.spark, folder, "c_custkey bigint, c_name string, c_acctbal double, c_nationkey int", ";")


@query("""SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS "row", s_suppkey, s_acctbal FROM supplier""")
def import_plain(t):
    """White-space separated numbers with their count and a comment before them, row by row."""
    folder = shared_folder(t.spark)
    n = t.supplier.count()
    body = exports.lines(paged(t.supplier, (), "s_suppkey"), ["s_suppkey", "s_acctbal"], "  ").select("s_suppkey", "line")
    head = t.spark.createDataFrame([(-2, "! suppliers"), (-1, str(n))], "s_suppkey bigint, line string")
    exports.write_lines(head.unionByName(body.withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))).coalesce(1), folder, order=("s_suppkey",))
    return imports.plain(t.spark, folder, {"s_suppkey": "bigint", "s_acctbal": "double"}, row_count=True).withColumn("row", F.col("row").cast("bigint"))


@query("SELECT c_mktsegment, count(*) AS n, R(sum(c_acctbal)) AS total FROM customer GROUP BY 1")
def split_in_pages(t):
    """A folder a page, read back as one table with its pages."""
    folder = shared_folder(t.spark)
    exports.write_pages(t.customer_pages, folder)
    return t.spark.read.parquet(folder).groupBy(F.col("c_mktsegment").cast("string").alias("c_mktsegment")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total"))
