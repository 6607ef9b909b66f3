"""Filters, expressions, casts and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import calendar
from quire.functions.editing import edited, nth_token, reformatted
from quire.functions.expression import Compiler, evaluated, infix
from quire.functions.wildcard import columns_like
from quire.operators import filters, joins
from quire.plans.registry import TIMED, query


@query("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 50")
def filter_range(t):
    return t.events.filter(filters.inside("value", 10, 50)).select("event_id", "value")


@query("SELECT o_orderkey FROM orders WHERE ((o_totalprice BETWEEN 1000 AND 200000) AND NOT (o_custkey BETWEEN 0 AND 500)) OR (o_orderkey BETWEEN 0 AND 50)")
def filter_terms(t):
    c = filters.combine(filters.inside("o_totalprice", 1000, 200000), ("&!", filters.inside("o_custkey", 0, 500)), ("|", filters.inside("o_orderkey", 0, 50)))
    return t.orders.filter(c).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, 's.*l .[aeiou].*')")
def match_wildcard(t):
    return filters.match_rows(t.part, "p_name", "s*l ?[aeiou]*").select("p_partkey", "p_name")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:30:00'")
def time_filter(t):
    s = F.col("t") + calendar.text_to_epoch(F.lit("2024/01/01 00:00:00"))
    return t.timed.filter(filters.time_filter(s, "2024/01/05 06:00:00", "2024/01/09 18:30:00")).select("event_id")


@query("SELECT p_partkey FROM part WHERE try_cast(right(p_brand, 2) AS DOUBLE) IS NOT NULL")
def number_test(t):
    return t.part.withColumn("s", F.expr("right(p_brand, 2)")).filter(filters.scans_as_number("s")).select("p_partkey")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE r >= 10 AND r < n - 5")
def clip_rows(t):
    return filters.clip(t.order_pages, 10, 5).rows.select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE NOT (r >= floor(n * 0.1) AND r < n - floor(n * 0.25))")
def clip_fraction_inverted(t):
    return filters.clip_fraction(t.order_pages, 0.1, 0.25, invert=True).rows.select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 3 AND (r - 3) % 10 = 0")
def sparse_rows(t):
    return filters.sparse(t.order_pages, 10, 3).rows.select("o_orderkey")


@query()
def sample_rows(t):
    return filters.sample(t.order_pages, 0.1).rows.select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def top_rows(t):
    return filters.top(t.order_pages, 5, F.desc("o_totalprice"), F.asc("o_orderkey")).rows.select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING avg(c_acctbal) > 4500)")
def page_test(t):
    p = t.customer_pages
    params = p.rows.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"))
    return filters.page_test(type(p)(p.rows, p.page, p.order, params), F.col("mean") > 4500).rows.select("c_custkey")


@query("""WITH m AS (SELECT c_mktsegment AS s, avg(c_acctbal) > 4200 AS ok FROM customer GROUP BY 1),
b AS (SELECT s, bool_and(ok) OVER (ORDER BY s) AS ok FROM m)
SELECT c_custkey FROM customer JOIN b ON s = c_mktsegment WHERE ok""")
def page_test_autostop(t):
    p = t.customer_pages
    params = p.rows.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"))
    return filters.page_test(type(p)(p.rows, p.page, p.order, params), F.col("mean") > 4200, autostop=True).rows.select("c_custkey")


@query(f"WITH {TIMED} SELECT event_id, R(sqrt(value * value + 4) + sin(t / 3600)) AS y, CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS k FROM t")
def define_stack_expression(t):
    c = Compiler({"value": F.col("value"), "t": F.col("t")}, {"hour": "3600 /"})
    return t.timed.select("event_id", c.number("value sqr 4 + sqrt t hour sin +").alias("y"), c.number("value 20 > ? pop pop 1 : pop pop 2 $").alias("k"))


@query(f"WITH {TIMED} SELECT event_id, R(CASE WHEN value > 20 AND t < 1000000 THEN pow(value, 2) / (1 + t) ELSE -value END) AS y FROM t")
def define_infix_expression(t):
    y = infix("value > 20 && t < 1000000 ? value ^ 2 / (1 + t) : -value", {"value": F.col("value"), "t": F.col("t")})
    return t.timed.select("event_id", y.alias("y"))


@query("SELECT event_id FROM events WHERE value > 20 AND NOT user_id < 100")
def test_rows(t):
    c = Compiler({"value": F.col("value"), "user": F.col("user_id").cast("double")})
    return t.events.filter(c.truth("value 20 > user 100 < ! &&")).select("event_id")


@query("SELECT c_custkey, R(c_acctbal * 0.92) AS c_acctbal FROM customer")
def convert_units(t):
    return t.customer.select("c_custkey", (F.col("c_acctbal") * 0.92).alias("c_acctbal", metadata={"units": "EUR"}))


@query("SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS whole, o_custkey::DOUBLE AS custkey FROM orders")
def cast_columns(t):
    return t.orders.select("o_orderkey", F.expr("cast(o_totalprice AS bigint)").alias("whole"), F.col("o_custkey").cast("double").alias("custkey"))


@query("SELECT c_custkey, try_cast(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS DOUBLE) AS number FROM customer")
def scan_number(t):
    return t.customer.select("c_custkey", F.regexp_extract("c_name", "#0*([0-9]+)$", 1).try_cast("double").alias("number"))


@query("SELECT c_custkey, replace(replace(c_name, 'Customer', 'Client'), '#', '-') AS name FROM customer")
def edit_replace(t):
    return t.customer.select("c_custkey", edited(F.col("c_name"), "%g/Customer/Client/%g/#/-/").alias("name"))


@query("SELECT c_custkey, 'x' || substr(c_name, 3, 6) || '#' AS name FROM customer")
def edit_cursor(t):
    return t.customer.select("c_custkey", edited(F.col("c_name"), "2di/x/S/#/Z").alias("name"))


@query("SELECT o_orderkey, printf('%08d:%.2f', o_orderkey, o_totalprice) AS label FROM orders")
def print_format(t):
    return t.orders.select("o_orderkey", F.format_string("%08d:%.2f", "o_orderkey", "o_totalprice").alias("label"))


@query("SELECT p_partkey, split_part(p_name, ' ', 2) AS word FROM part")
def text_token(t):
    return t.part.select("p_partkey", nth_token(F.col("p_name"), 2).alias("word"))


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def retain_columns(t):
    return t.lineitem.select(*columns_like(t.lineitem, "l_order*", "*[qx]*ntity", "*price"))


@query("""SELECT event_id, year(ts)::INT AS "Year", dayofyear(ts)::INT AS "JulianDay", month(ts)::INT AS "Month", day(ts)::INT AS "Day",
R(epoch_us(ts - date_trunc('day', ts)) / 3.6e9) AS "Hour", strftime(ts, '%Y/%m/%d %H:%M:%S') AS "Text" FROM events""")
def time_breakdown(t):
    s = F.col("t") + calendar.text_to_epoch(F.lit("2024/01/01 00:00:00"))
    return t.timed.select("event_id", *[c.alias(n) for n, c in calendar.breakdown(s).items()])


@query("SELECT o_orderkey, epoch(o_orderdate)::DOUBLE AS epoch FROM orders")
def time_to_epoch(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", calendar.epoch(F.year(d), F.month(d), F.dayofmonth(d), F.hour(d)).alias("epoch"))


@query("SELECT o_orderkey, bin(o_orderkey) AS bits FROM orders")
def binary_string(t):
    return t.orders.select("o_orderkey", F.bin("o_orderkey").alias("bits"))


@query("SELECT p_partkey, R(2 + 0.5 * p_size + 0.01 * p_size * p_size * p_retailprice) AS v FROM part")
def evaluate_polynomial(t):
    return joins.polynomial(t.part, [(2, {"p_size": 0}), (0.5, {"p_size": 1}), (0.01, {"p_size": 2, "p_retailprice": 1})], "v").select("p_partkey", "v")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT a.c_custkey, b.c_acctbal AS v FROM r a JOIN r b ON a.c_mktsegment = b.c_mktsegment AND b.i = a.c_nationkey * 20""")
def dereference(t):
    return joins.dereference(t.customer_pages, F.col("c_nationkey") * 20, "c_acctbal", "v").select("c_custkey", "v")


@query("SELECT 'o_orderkey' AS name, 'bigint' AS type UNION ALL SELECT 'o_custkey', 'bigint' UNION ALL SELECT 'o_orderstatus', 'string' UNION ALL SELECT 'o_totalprice', 'double' UNION ALL SELECT 'o_orderdate', 'timestamp_ntz' UNION ALL SELECT 'o_orderpriority', 'string'")
def describe_columns(t):
    return t.spark.createDataFrame(t.orders.dtypes, "name string, type string")


@query("SELECT user_id, n, repeat('*', (n // 10)::INT) AS bar FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def sequence_of_counts(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "n", F.expr("repeat('*', cast(n div 10 AS int))").alias("bar"))


@query("SELECT i::BIGINT AS page, j * 0.25 AS x, R(sin(j * 0.25) * i) AS y FROM range(3) a(i), range(41) b(j)", name="sequence_repeat")
def sequence_repeat(t):
    from quire.sources.generate import sequences

    out = sequences(t.spark, {"x": (0.0, 10.0, 0.25)}, repeat=3)
    return out.select("page", "x", (F.sin("x") * F.col("page")).alias("y"))


@query("SELECT x / 4.0 AS x, y / 2.0 AS y, R(exp(-(pow(x / 4.0, 2) + pow(y / 2.0, 2)) / 10)) AS z FROM range(0, 9) a(x), range(0, 5) b(y)")
def contour_grid(t):
    from quire.sources.generate import grid

    return grid(t.spark, "x", (0.0, 2.0, 9), "y", (0.0, 2.0, 5), "z", "x sqr y sqr + 10 / -1 * exp")


@query("""SELECT o_orderkey, printf('%07d', o_orderkey) || ' at ' || printf('%.3f', o_totalprice) || ' [' || o_orderstatus || ']' AS s FROM orders""")
def format_numbers(t):
    text = F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.lit("at"), F.format_string("%.2f", "o_totalprice"), F.concat(F.lit("["), "o_orderstatus", F.lit("]")))
    return t.orders.select("o_orderkey", reformatted(text, double="%.3f", long="%07d").alias("s"))


@query("SELECT event_id, R(CASE event_type WHEN 'click' THEN value * 2 WHEN 'view' THEN value + user_id ELSE value * value - 1 END) AS y FROM events")
def evaluate_stored(t):
    stored = F.when(F.col("event_type") == "click", "value 2 *").when(F.col("event_type") == "view", "value user_id +").otherwise("value sqr 1 -")
    out = evaluated(t.events.withColumn("equation", stored), "equation", "y", {"value": F.col("value"), "user_id": F.col("user_id").cast("double")})
    return out.select("event_id", "y")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def require_columns(t):
    return filters.require(t.customer_pages, ["c_custkey"], absent_columns=["no_such"]).reduce(F.count(F.lit(1)).alias("n"))
