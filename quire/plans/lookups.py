"""Joins and interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.frame import paged
from quire.operators import joins as J
from quire.plans.registry import TIMED, query

_L = "SELECT *, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS k, user_id % 25 AS key FROM events WHERE event_type = 'click'"
_R = "SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer"


def _left(t):
    return paged(t.events.filter("event_type = 'click'").withColumn("key", F.col("user_id") % 25), (), "event_id")


def _right(t):
    return paged(t.customer, (), "c_custkey")


@query(f"WITH l AS ({_L}), r AS ({_R}) SELECT event_id, key, c_custkey, c_name FROM l JOIN r ON key = c_nationkey AND l.k = r.k")
def lookup_consuming(t):
    return J.lookup(_left(t), _right(t), {"key": "c_nationkey"}, ["c_custkey", "c_name"]).select("event_id", "key", "c_custkey", "c_name")


@query(f"WITH l AS ({_L}), r AS ({_R}) SELECT event_id, key, coalesce(c_custkey, 0) AS c_custkey, coalesce(c_name, '') AS c_name FROM l LEFT JOIN r ON key = c_nationkey AND l.k = r.k")
def lookup_fill(t):
    return J.lookup(_left(t), _right(t), {"key": "c_nationkey"}, ["c_custkey", "c_name"], fill=True).select("event_id", "key", "c_custkey", "c_name")


@query(f"WITH l AS ({_L}), r AS ({_R}) SELECT event_id, key, c_custkey FROM l JOIN r ON key = c_nationkey AND r.k = 1")
def lookup_reuse(t):
    return J.lookup(_left(t), _right(t), {"key": "c_nationkey"}, ["c_custkey"], reuse=True).select("event_id", "key", "c_custkey")


@query("""WITH l AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT o_orderkey AS other, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1)
SELECT l.o_orderkey, other FROM l JOIN r ON l.o_custkey = r.o_custkey AND l.o_orderstatus = r.o_orderstatus AND l.k = r.k""")
def lookup_several_keys(t):
    a = paged(t.orders.filter("o_orderkey % 2 = 0"), (), "o_orderkey")
    b = paged(t.orders.filter("o_orderkey % 2 = 1").withColumn("other", F.col("o_orderkey")), (), "o_orderkey")
    return J.lookup(a, b, {"o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus"}, ["other"]).select("o_orderkey", "other")


@query("""WITH a AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer), b AS (SELECT c_acctbal AS other, c_mktsegment AS s, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS k FROM customer)
SELECT c_custkey, other FROM a JOIN b ON c_mktsegment = s AND a.k = b.k""")
def zip_by_position(t):
    b = paged(t.customer.withColumn("other", F.col("c_acctbal")), "c_mktsegment", ("c_acctbal", "c_custkey"))
    return J.zip_rows(t.customer_pages, b, ["other"]).select("c_custkey", "other")


@query("""SELECT p_partkey, CASE WHEN p_name LIKE 's%' THEN 1.5 WHEN p_name LIKE '%ring' THEN 2.5 WHEN p_name LIKE 'r__ %' THEN 3.5 END::DOUBLE AS v FROM part WHERE p_name LIKE 's%' OR p_name LIKE '%ring' OR p_name LIKE 'r__ %'""")
def lookup_wildcard(t):
    patterns = t.spark.createDataFrame([(1, "s*", 1.5), (2, "*ring", 2.5), (3, "r?? *", 3.5)], "n int, pattern string, v double")
    return J.wildcard_lookup(paged(t.part, (), "p_partkey"), paged(patterns, (), "n"), "p_name", "pattern", ["v"]).select("p_partkey", "v")


@query("""SELECT c_custkey, (SELECT s_suppkey FROM supplier WHERE s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 500 ORDER BY s_suppkey LIMIT 1) AS s_suppkey FROM customer
WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 500)""")
def lookup_tolerance(t):
    return J.tolerance_lookup(paged(t.customer, (), "c_custkey"), paged(t.supplier, (), "s_suppkey"), {"c_nationkey": "s_nationkey"}, ("c_acctbal", "s_acctbal"), 500.0, ["s_suppkey"]).select("c_custkey", "s_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def select_matching(t):
    return J.matching_rows(paged(t.orders, (), "o_orderkey"), paged(t.customer.filter("c_acctbal < 0"), (), "c_custkey"), {"o_custkey": "c_custkey"}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def select_not_matching(t):
    return J.matching_rows(paged(t.orders, (), "o_orderkey"), paged(t.customer.filter("c_acctbal < 0"), (), "c_custkey"), {"o_custkey": "c_custkey"}, invert=True).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def select_consuming(t):
    return J.matching_rows(paged(t.orders, (), "o_orderkey"), paged(t.customer, (), "c_custkey"), {"o_custkey": "c_custkey"}, reuse=False).select("o_orderkey")


@query("SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) WHERE (l_orderkey, l_suppkey) IN (SELECT o_orderkey, o_custkey % 100 FROM orders)")
def select_several_keys(t):
    l = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    return J.matching_rows(paged(l, (), "l_orderkey"), paged(t.orders.withColumn("s", F.col("o_custkey") % 100), (), "o_orderkey"), {"l_orderkey": "o_orderkey", "l_suppkey": "s"}).select("l_orderkey")


@query("""WITH a AS (SELECT c_mktsegment, c_custkey, c_acctbal, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS r FROM customer)
SELECT c_mktsegment, r AS "Row", 'c_acctbal' AS "Column", c_acctbal AS "First", R(CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END) AS "Second" FROM a WHERE c_custkey % 10 = 0""")
def differences(t):
    b = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return J.differences(t.customer_pages, paged(b, "c_mktsegment", "c_custkey"), ["c_acctbal", "c_nationkey"], tolerance=0.5)


_POINTS = "SELECT c_mktsegment, c_nationkey::DOUBLE AS x, avg(c_acctbal) AS y FROM customer GROUP BY 1, 2"


@query(f"""WITH d AS ({_POINTS}), v AS (SELECT c_mktsegment, x, y FROM (SELECT DISTINCT c_mktsegment FROM customer), (SELECT unnest([-3.0, 0.25, 4.0, 7.75, 30.0])::DOUBLE AS x) q, (SELECT NULL::DOUBLE AS y)),
lo AS (SELECT v.c_mktsegment, v.x, max(d.x) AS x0 FROM v LEFT JOIN d ON d.c_mktsegment = v.c_mktsegment AND d.x <= v.x GROUP BY 1, 2), hi AS (SELECT v.c_mktsegment, v.x, min(d.x) AS x1 FROM v LEFT JOIN d ON d.c_mktsegment = v.c_mktsegment AND d.x >= v.x GROUP BY 1, 2)
SELECT lo.c_mktsegment, lo.x AS c_nationkey, R(CASE WHEN x0 IS NULL THEN b.y WHEN x1 IS NULL THEN a.y WHEN x0 = x1 THEN a.y ELSE a.y + (lo.x - x0) * (b.y - a.y) / (x1 - x0) END) AS c_acctbal
FROM lo JOIN hi ON lo.c_mktsegment = hi.c_mktsegment AND lo.x = hi.x LEFT JOIN d a ON a.c_mktsegment = lo.c_mktsegment AND a.x = x0 LEFT JOIN d b ON b.c_mktsegment = lo.c_mktsegment AND b.x = x1""")
def interpolate_linear(t):
    at = t.spark.createDataFrame([(x,) for x in (-3.0, 0.25, 4.0, 7.75, 30.0)], "x double")
    return J.interpolate(paged(t.customer, "c_mktsegment", "c_custkey"), "c_nationkey", "c_acctbal", at, "x")


@query(f"""WITH d AS ({_POINTS}), a AS (SELECT c_mktsegment, regr_slope(y, x) AS m, regr_intercept(y, x) AS b FROM d WHERE x <= 1 GROUP BY 1), z AS (SELECT c_mktsegment, regr_slope(y, x) AS m, regr_intercept(y, x) AS b FROM d WHERE x >= 23 GROUP BY 1)
SELECT c_mktsegment, -3.0::DOUBLE AS c_nationkey, R(b - 3 * m) AS c_acctbal FROM a UNION ALL SELECT c_mktsegment, 30.0, R(b + 30 * m) FROM z""")
def interpolate_extrapolate(t):
    at = t.spark.createDataFrame([(x,) for x in (-3.0, 30.0)], "x double")
    return J.interpolate(paged(t.customer, "c_mktsegment", "c_custkey"), "c_nationkey", "c_acctbal", at, "x", "extrapolate")


@query(f"""WITH d AS ({_POINTS}), a AS (SELECT c_mktsegment, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, min(x) OVER (PARTITION BY c_mktsegment) AS lo, max(x) OVER (PARTITION BY c_mktsegment) AS hi FROM d WINDOW w AS (PARTITION BY c_mktsegment ORDER BY x)),
v AS (SELECT DISTINCT c_mktsegment, q, CASE WHEN q > hi THEN q - ceil((q - hi) / (hi - lo)) * (hi - lo) WHEN q < lo THEN q + ceil((lo - q) / (hi - lo)) * (hi - lo) ELSE q END AS xw FROM a, (SELECT unnest([-30.5, 2.5, 61.25])::DOUBLE AS q))
SELECT v.c_mktsegment, q AS c_nationkey, R(y + (xw - x) * (y1 - y) / (x1 - x)) AS c_acctbal FROM v JOIN a ON a.c_mktsegment = v.c_mktsegment AND x <= xw AND xw < x1""")
def interpolate_wrapped(t):
    at = t.spark.createDataFrame([(x,) for x in (-30.5, 2.5, 61.25)], "x double")
    return J.interpolate(paged(t.customer, "c_mktsegment", "c_custkey"), "c_nationkey", "c_acctbal", at, "x", "wrap")


@query("SELECT DISTINCT c_mktsegment, q AS c_nationkey, -7.5::DOUBLE AS c_acctbal FROM customer, (SELECT unnest([-30.5, 61.25])::DOUBLE AS q)")
def interpolate_outside_value(t):
    at = t.spark.createDataFrame([(x,) for x in (-30.5, 61.25)], "x double")
    return J.interpolate(paged(t.customer, "c_mktsegment", "c_custkey"), "c_nationkey", "c_acctbal", at, "x", -7.5)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_quantity > 10 AND l_quantity < 30 AND l_tax > 0.015 AND l_tax < 0.055")
def inside_boundary(t):
    out = J.inside_polygon(t.lineitem, "l_quantity", "l_tax", [(10.5, 0.015), (29.5, 0.015), (29.5, 0.055), (10.5, 0.055)])
    return out.filter("InsideSum <> 0").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")


@query("""WITH p AS (SELECT s_suppkey, (s_nationkey + 0.3)::DOUBLE AS x, (s_acctbal / 1000)::DOUBLE AS y FROM supplier), g AS (SELECT DISTINCT c_nationkey::DOUBLE AS gx, round(c_acctbal / 1000) AS gy FROM customer)
SELECT s_suppkey, gx, gy FROM (SELECT s_suppkey, gx, gy, row_number() OVER (PARTITION BY s_suppkey ORDER BY pow(x - gx, 2) + pow(y - gy, 2), gx, gy) AS k FROM p, g) WHERE k = 1""")
def nearest_in_grid(t):
    p = t.supplier.select("s_suppkey", (F.col("s_nationkey") + 0.3).alias("x"), (F.col("s_acctbal") / 1000).alias("y"))
    g = t.customer.select(F.col("c_nationkey").cast("double").alias("x"), F.round(F.col("c_acctbal") / 1000).alias("y")).distinct()
    g = g.withColumn("gx", F.col("x")).withColumn("gy", F.col("y"))
    return J.nearest_in_grid(p, g, "x", "y", 2.0, ["gx", "gy"]).select("s_suppkey", "gx", "gy")
