"""Ordered analytics, sorting and reshaping."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quire.frame import paged
from quire.operators import blocks
from quire.operators import ordered as O
from quire.operators import pages as P
from quire.plans.registry import SQL, TIMED, query

_W = "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"
_R = 'row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1'
_N = "count(*) OVER (PARTITION BY event_type)"


@query(f"""WITH s AS (SELECT event_type, {_R} AS "Row", {_N} AS n, avg(value) OVER f AS a, min(value) OVER f AS b, max(value) OVER f AS c, stddev_samp(value) OVER f AS d, sqrt(avg(value * value) OVER f) AS e, list_sort(list(value) OVER f)[6] AS m
FROM events WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT event_type, "Row", R(a) AS "valueMean", R(b) AS "valueMin", R(c) AS "valueMax", R(d) AS "valueStDev", R(e) AS "valueRMS", R(m) AS "valueMedian" FROM s WHERE "Row" <= n - 10""")
def running_statistics(t):
    return O.running(t.event_pages, "value", 10, ["Mean", "Min", "Max", "StDev", "RMS", "Median"])


@query(f"""WITH s AS (SELECT event_type, value, {_R} AS r, {_N} AS n FROM events)
SELECT event_type, (r // 25) * 25 AS "Row", R(avg(value)) AS "valueMean", R(sum(value)) AS "valueSum" FROM s WHERE (r // 25 + 1) * 25 <= n GROUP BY event_type, r // 25""")
def blocked_statistics(t):
    return O.running(t.event_pages, "value", 25, ["Mean", "Sum"], overlap=False)


@query(f"""WITH {TIMED}, s AS (SELECT event_type, {_R} AS "Row", {_N} AS n, regr_slope(value, t) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM t)
SELECT event_type, "Row", R(s) AS "valueSlope" FROM s WHERE "Row" <= n - 10""")
def running_slope(t):
    return O.running_slope(t.event_pages, "value", "t", 10)


@query(f"WITH {TIMED} SELECT event_id, R(avg(value) OVER v) AS \"valueMean\", R(max(value) OVER v) AS \"valueMax\" FROM t WINDOW v AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING)")
def running_by_value(t):
    return O.running_by_value(t.event_pages, "value", "t", 3600.0, ["Mean", "Max"]).select("event_id", "valueMean", "valueMax")


@query("""WITH a AS (SELECT *, avg(value) OVER f AS v FROM events WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT event_id, avg(v) OVER f AS v FROM a WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT event_id, R(v) AS value FROM b""")
def smooth_boxcar(t):
    return O.smooth(t.event_pages, "value", 5, 2).rows.select("event_id", "value")


@query("SELECT event_id, R(value - avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS d FROM events")
def smooth_difference(t):
    p = t.event_pages
    return O.difference_from(p, O.smooth(p, "value", 5), "value", "d").rows.select("event_id", "d")


@query("""WITH a AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM events) SELECT event_id, R(l[len(l) // 2 + 1]) AS m FROM a""")
def median_filter(t):
    return O.median_filter(t.event_pages, "value", 5, "m").rows.select("event_id", "m")


@query(f"""WITH a AS (SELECT event_id, value AS x, first_value(value) OVER g AS f, last_value(value) OVER g AS z, lag(value, 2) OVER w AS a2, lag(value, 1) OVER w AS a1, lead(value, 1) OVER w AS b1, lead(value, 2) OVER w AS b2 FROM events
{_W}, g AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, R((-3 * coalesce(a2, f) + 12 * coalesce(a1, f) + 17 * x + 12 * coalesce(b1, z) - 3 * coalesce(b2, z)) / 35) AS s FROM a""")
def savitzky_golay(t):
    return O.savitzky_golay(t.event_pages, "value", 2, 2, 2, "s").rows.select("event_id", "s")


@query(f"SELECT event_id, coalesce(lag(value, 3) OVER w, first_value(value) OVER w) AS \"Shiftedvalue\" FROM events {_W}")
def shift_rows(t):
    return O.shift(t.event_pages, "value", 3).rows.select("event_id", "Shiftedvalue")


@query(f"""WITH r AS (SELECT *, {_R} AS r, {_N} AS n FROM events) SELECT a.event_id, b.value AS "Shiftedvalue" FROM r a JOIN r b ON a.event_type = b.event_type AND a.r = (b.r + 3) % a.n""")
def shift_circular(t):
    return O.shift(t.event_pages, "value", 3, "circular").rows.select("event_id", "Shiftedvalue")


@query(f"""WITH s AS (SELECT event_id, event_type, ts, value, value - lag(value) OVER w AS d FROM events {_W}), k AS (SELECT *, CASE WHEN d > 50 THEN -1 WHEN d < -50 THEN 1 ELSE 0 END AS k FROM s)
SELECT event_id, R(value + 100 * sum(k) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS "Unwrapvalue" FROM k""")
def unwrap_phase(t):
    return O.unwrap(t.event_pages, "value", 50.0, 100.0).rows.select("event_id", "Unwrapvalue")


@query(f"""WITH {TIMED}, s AS (SELECT event_id, coalesce(lag(value) OVER w, value) AS y0, coalesce(lead(value) OVER w, value) AS y1, coalesce(lag(t) OVER w, t) AS x0, coalesce(lead(t) OVER w, t) AS x1 FROM t {_W})
SELECT event_id, R((y1 - y0) / (x1 - x0)) AS "valueDeriv", R((x0 + x1) / 2) AS "valueDerivPosition" FROM s""")
def derivative(t):
    return O.derivative(t.event_pages, "value", "t").rows.select("event_id", "valueDeriv", "valueDerivPosition")


@query(f"""WITH {TIMED}, s AS (SELECT event_id, event_type, ts, coalesce((value + lag(value) OVER w) * (t - lag(t) OVER w) / 2, 0) AS a FROM t {_W})
SELECT event_id, R(sum(a) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS i FROM s""")
def cumulative_integral(t):
    return O.cumulative_integral(t.event_pages, "value", "t", "i").rows.select("event_id", "i")


@query(f"""WITH s AS (SELECT event_id, value AS x, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events {_W})
SELECT event_id, x AS value FROM s WHERE ((a < x AND b < x) OR (a = x AND b < x) OR (a < x AND b = x)) AND x >= 60""")
def find_peaks(t):
    return O.peaks(t.event_pages, "value", 60.0).rows.select("event_id", "value")


@query("""WITH s AS (SELECT c_custkey, c_acctbal AS x, lag(c_acctbal) OVER w AS a, lead(c_acctbal) OVER w AS b, c_custkey - lag(c_custkey) OVER w AS l, lead(c_custkey) OVER w - c_custkey AS r FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey))
SELECT c_custkey FROM s WHERE ((a < x AND b < x) OR (a = x AND b < x) OR (a < x AND b = x)) AND abs(((b - x) / r - (x - a) / l) / (l + r)) >= 50 AND (x = 0 OR (x - a) / nullif(x, 0) > 0.5 OR (x - b) / nullif(x, 0) > 0.5)""")
def find_peaks_curved(t):
    return O.peaks(t.customer_pages, "c_acctbal", change=0.5, x="c_custkey", curvature=50.0).rows.select("c_custkey")


@query(f"""WITH s AS (SELECT event_id, value AS x, lag(value) OVER w AS a, lead(value) OVER w AS b, lag(value, 2) OVER w AS a2, lead(value, 2) OVER w AS b2 FROM events {_W})
SELECT event_id, x AS value FROM s WHERE ((a < x AND b < x) OR (a = x AND b < x) OR (a < x AND b = x)) AND a2 < a AND b2 < b""")
def find_peaks_five_point(t):
    return O.peaks(t.event_pages, "value", points=5).rows.select("event_id", "value")


@query(f"""WITH {TIMED}, s AS (SELECT event_type, t AS x, value - 50 AS y, lag(t) OVER w AS x0, lag(value - 50) OVER w AS y0 FROM t {_W}), k AS (SELECT *, CASE WHEN x = x0 THEN 1.7976931348623157e308::DOUBLE ELSE (y - y0) / (x - x0) END AS m FROM s WHERE (y0 <= 0 AND y >= 0) OR (y0 >= 0 AND y <= 0))
SELECT event_type, R(CASE WHEN m = 0 THEN x0 ELSE x0 - y0 / m END) AS t, 50.0::DOUBLE AS value, R(m) AS "valueSlope" FROM k""")
def find_zeros(t):
    return O.zero_crossings(t.event_pages, "value", "t", -50.0)


def _equal_pages(t):
    """Pages of one length without a cut: page k holds a function of every customer's balance."""
    page = F.explode(F.array(*[F.struct(F.lit(k).alias("page"), (F.col("c_acctbal") * (k + 1) + k * F.col("c_nationkey")).alias("v")) for k in range(4)])).alias("s")
    return paged(t.customer.select("c_custkey", page).select("c_custkey", "s.*"), "page", "c_custkey")


_EQUAL = "e AS (SELECT c_custkey, k::INT AS page, c_acctbal * (k + 1) + k * c_nationkey AS v, row_number() OVER (PARTITION BY k ORDER BY c_custkey) - 1 AS i FROM customer, range(4) r(k))"


@query(f'WITH {_EQUAL} SELECT a.page, a.i AS "Row", R(a.v - b.v) AS "ChangeInv" FROM e a JOIN e b ON b.page = 1 AND a.i = b.i WHERE a.page <> 1')
def changes_from_page(t):
    return O.changes(_equal_pages(t), ["v"], 1)


@query("""WITH a AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type)), b AS (SELECT * FROM a WHERE NOT abs(value - m) > 2 * s),
c AS (SELECT *, avg(value) OVER w AS m2, stddev_samp(value) OVER w AS s2 FROM b WINDOW w AS (PARTITION BY event_type)) SELECT event_id FROM c WHERE NOT abs(value - m2) > 2 * s2""")
def remove_outliers(t):
    return O.outliers(t.event_pages, "value", 2.0, 2).rows.select("event_id")


@query("""WITH a AS (SELECT *, CASE WHEN abs(value - avg(value) OVER w) > 3 * stddev_samp(value) OVER w THEN NULL ELSE value END AS g FROM events WINDOW w AS (PARTITION BY event_type))
SELECT event_id, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id), first_value(g IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM a""")
def replace_outliers(t):
    return O.outliers(t.event_pages, "value", 3.0, 1, "last").rows.select("event_id", "value")


@query("""WITH h AS (SELECT event_type, least(floor((value - min(value) OVER w) / ((max(value) OVER w - min(value) OVER w) / 20)), 20) AS b, event_id FROM events WINDOW w AS (PARTITION BY event_type)),
c AS (SELECT event_type, b, count(*) AS n FROM h WHERE b < 20 GROUP BY 1, 2), f AS (SELECT event_type, arg_max(b, (n, -b)) AS most FROM c GROUP BY 1) SELECT event_id FROM h JOIN f USING (event_type) WHERE b = most""")
def keep_popular(t):
    return O.outliers(t.event_pages, "value", None, unpopular=20).rows.select("event_id")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
q AS (SELECT event_type, max(value) FILTER (WHERE k = floor((n - 1) * 0.05)) AS lo, max(value) FILTER (WHERE k = floor((n - 1) * 0.9)) AS hi FROM o GROUP BY 1) SELECT event_id, (value < lo OR value > hi)::INT AS "IsOutlier" FROM events JOIN q USING (event_type)""")
def mark_percentile_outliers(t):
    return O.outliers(t.event_pages, "value", None, percentiles=(5.0, 90.0), mode="mark").rows.select("event_id", "IsOutlier")


@query("""WITH a AS (SELECT *, abs(value - avg(value) OVER (PARTITION BY event_type)) > 40 AS bad, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT *, last_value(CASE WHEN NOT bad THEN i END IGNORE NULLS) OVER w AS i0, last_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER w AS v0, first_value(CASE WHEN NOT bad THEN i END IGNORE NULLS) OVER f AS i1, first_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER f AS v1 FROM a
WINDOW w AS (PARTITION BY event_type ORDER BY i), f AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, R(CASE WHEN NOT bad THEN value WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (i1 - i0) * (i - i0) END) AS value FROM b""")
def interpolate_outliers(t):
    return O.outliers(t.event_pages, "value", None, deviation=40.0, mode="interpolate").rows.select("event_id", "value")


@query(f"""WITH g AS (SELECT event_id, {", ".join(f"coalesce(lag(value, {k}) OVER w, 0) * {math.exp(-((k / 0.8) ** 2) / 2) / (0.8 * math.sqrt(2 * math.pi))!r}::DOUBLE AS a{k}, coalesce(lead(value, {k}) OVER w, 0) * {math.exp(-((k / 0.8) ** 2) / 2) / (0.8 * math.sqrt(2 * math.pi))!r}::DOUBLE AS b{k}" for k in range(1, 5))}, value * {1 / (0.8 * math.sqrt(2 * math.pi))!r}::DOUBLE AS c FROM events {_W})
SELECT event_id, R(a1 + a2 + a3 + a4 + b1 + b2 + b3 + b4 + c) AS s FROM g""")
def smooth_gaussian(t):
    return O.gaussian_smooth(t.event_pages, "value", 0.8, "s").rows.select("event_id", "s")


@query()
def smooth_despike(t):
    return O.despike(t.event_pages, "value", 4, 2, threshold=20.0)


@query("""WITH g AS (SELECT *, abs(value - avg(value) OVER w) <= 2 * stddev_pop(value) OVER w AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events WINDOW w AS (PARTITION BY event_type)),
f AS (SELECT event_type, regr_slope(value, i) AS b, regr_intercept(value, i) AS a FROM g WHERE ok GROUP BY 1) SELECT event_id, R(value - a - b * i) AS value, ok::INT AS "SelectedForBaselineDetermination" FROM g JOIN f USING (event_type)""")
def subtract_fitted_baseline(t):
    return O.subtract_baseline(t.event_pages, "value", outlier_passes=1, terms=2).rows.select("event_id", "value", "SelectedForBaselineDetermination")


@query(f"""WITH s AS (SELECT *, {_R} AS r, {_N} AS n FROM events), b AS (SELECT event_type AS e, avg(value) AS b FROM s WHERE r < 20 OR r >= n - 20 GROUP BY 1) SELECT event_id, R(value - b) AS value FROM s JOIN b ON e = event_type""")
def subtract_baseline(t):
    return O.subtract_baseline(t.event_pages, "value", 20).rows.select("event_id", "value")


#: Where each page's pattern starts.
_STATES = f"s AS (SELECT *, {_R} AS r, {_N} AS n FROM events), d AS (SELECT *, (max(value) FILTER (WHERE r = 0) OVER w <> max(value) FILTER (WHERE r = 1) OVER w)::INT AS d FROM s WINDOW w AS (PARTITION BY event_type))"


@query(f"""WITH {_STATES}, h AS (SELECT *, (r - d + 2) % 2 < 1 AS h FROM d) SELECT event_id, R(value - avg(value) OVER (PARTITION BY event_type, h)) AS value FROM h""")
def remove_offsets(t):
    return O.remove_offsets(t.event_pages, "value").rows.select("event_id", "value")


@query(f"""WITH {_STATES}, h AS (SELECT *, (r - d + 4) % 4 < 2 AS h, r < 0.5 * n AS head FROM d), o AS (SELECT event_type AS e, avg(value) FILTER (WHERE head AND h) AS a, avg(value) FILTER (WHERE head AND NOT h) AS b FROM h GROUP BY 1)
SELECT event_id, R(value - CASE WHEN h THEN a ELSE b END + (a + b) / 2) AS value FROM h JOIN o ON e = event_type""")
def remove_commutation(t):
    return O.remove_offsets(t.event_pages, "value", 4, head=0.5, commutation_only=True).rows.select("event_id", "value")


#: Rows, and the place of each page's first maximum.
_TOP = f"s AS (SELECT *, {_R} AS r, max(value) OVER (PARTITION BY event_type) AS m FROM events), a AS (SELECT event_type AS e, min(r) FILTER (WHERE value = m) AS top FROM s GROUP BY 1)"


@query(f"""WITH {_TOP}, b AS (SELECT e, max(r) FILTER (WHERE r < top AND value < 0.5 * m) AS lo, min(r) FILTER (WHERE r > top AND value < 0.5 * m) AS hi FROM s JOIN a ON e = event_type GROUP BY 1)
SELECT event_id, CASE WHEN r <= coalesce(lo, -1) OR r >= coalesce(hi, r + 1) THEN 0 ELSE value END AS value FROM s JOIN b ON e = event_type""")
def clip_tails(t):
    return O.clip_tails(t.event_pages, "value", 0.5).rows.select("event_id", "value")


@query(f"""WITH {_TOP}, b AS (SELECT e, max(r) FILTER (WHERE r < top AND value < 1) AS lo, min(r) FILTER (WHERE r > top AND value < 1) AS hi FROM s JOIN a ON e = event_type GROUP BY 1),
c AS (SELECT event_id, value, r <= coalesce(lo, -1) OR r >= coalesce(hi, r + 1) AS c FROM s JOIN b ON e = event_type) SELECT event_id, CASE WHEN c THEN 0 ELSE value END AS value, c::INT AS "InTail" FROM c""")
def clip_tails_below(t):
    return O.clip_tails(t.event_pages, "value", 0.9, limit=1.0, in_tail=True).rows.select("event_id", "value", "InTail")


@query("SELECT event_id, R(value / (max(value) OVER w - min(value) OVER w)) AS a, R(value / sqrt(avg(value * value) OVER w)) AS b FROM events WINDOW w AS (PARTITION BY event_type)")
def normalize_columns(t):
    p = O.normalize(t.event_pages, "value", "spread", "a")
    return O.normalize(p, "value", "rms", "b").rows.select("event_id", "a", "b")


@query(f"WITH {TIMED} SELECT user_id, arg_max(value, (t, event_id)) AS value FROM t WHERE t <= 1000000 GROUP BY 1")
def log_snapshot(t):
    return O.snapshot(t.event_pages, "user_id", "value", "t", 1e6)


@query("""SELECT event_id, last_value(CASE WHEN value > 30 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS value FROM events""")
def fill_forward(t):
    p = t.event_pages
    return O.fill_forward(p.with_rows(p.rows.withColumn("value", F.when(F.col("value") > 30, F.col("value")))), "value").rows.select("event_id", "value")


@query("SELECT p_brand, p_type, p_partkey FROM part")
def sort_rows(t):
    return P.sort_rows(t.part.select("p_brand", "p_type", "p_partkey"), "p_brand", "-p_type", "p_partkey")


@query("SELECT p_partkey, regexp_replace(p_brand, '[0-9]+$', '') || lpad(regexp_extract(p_brand, '([0-9]+)$', 1), 20, '0') AS k FROM part")
def numeric_high_key(t):
    return t.part.select("p_partkey", P.numeric_high_key("p_brand").alias("k"))


@query("""SELECT c_mktsegment, c_nationkey, min(c_custkey) AS c_custkey, count(*) AS "IdenticalCount" FROM customer GROUP BY 1, 2""")
def unique_rows(t):
    return P.unique(t.customer_pages, "c_nationkey", count=True).rows.select("c_mktsegment", "c_nationkey", "c_custkey", "IdenticalCount")


@query("""SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))""")
def pareto_front(t):
    return P.pareto(paged(t.part, "p_brand", "p_partkey"), "p_size", "p_retailprice").rows.select("p_partkey")


@query("""WITH RECURSIVE p AS (SELECT p_brand AS g, p_partkey AS i, p_size AS a, p_retailprice AS b FROM part),
w AS (SELECT x.g, x.i, y.i AS j FROM p x JOIN p y ON x.g = y.g AND y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b)),
r AS (SELECT 1 AS k, g, i FROM p UNION SELECT r.k + 1, w.g, w.i FROM r JOIN w ON w.g = r.g AND w.j = r.i) SELECT g AS p_brand, i AS p_partkey, max(k) AS "Rank" FROM r GROUP BY 1, 2""")
def pareto_ranks(t):
    return P.pareto_ranks(paged(t.part, "p_brand", "p_partkey"), ["p_size", "p_retailprice"]).select("p_brand", "p_partkey", "Rank")


@query("SELECT n_name, n_nationkey, n_regionkey FROM nation")
def sort_columns(t):
    return P.sort_columns(t.nation)


@query("SELECT n_nationkey, unnest(range(n_regionkey + 1))::INT AS \"Copy\" FROM nation")
def duplicate_rows(t):
    return P.duplicate(t.nation, F.col("n_regionkey") + 1).select("n_nationkey", "Copy")


@query("""SELECT s_suppkey AS k, s_acctbal AS bal, NULL AS seg, 's' AS "Filename", 2 AS "NumberCombined" FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 'c', 2 FROM customer""")
def combine_files(t):
    return P.combine(s=t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")), c=t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")))


@query(f"""WITH s AS (SELECT event_type, value, ({_R}) // 10 AS "Group" FROM events) SELECT event_type, "Group", R(avg(value)) AS value FROM s GROUP BY 1, 2""")
def combine_sparse(t):
    return P.sparse_groups(t.event_pages, "value", 10)


@query("""SELECT a.user_id, v, c FROM (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN (SELECT user_id, max(value) AS c FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.user_id = b.user_id""")
def combine_logs(t):
    last = lambda e: t.events.filter(F.col("event_type") == e).groupBy("user_id").agg(F.max("value").alias("value"))
    return P.combine_logs({"v": last("view"), "c": last("click")}, time="user_id")


def _break_sql(boundary: str, extra: str = "") -> str:
    return f"""WITH {TIMED}, b AS (SELECT event_id, event_type, ts, coalesce({boundary}, false)::INT AS b FROM t {_W}) SELECT event_id, (sum(b) OVER (PARTITION BY event_type ORDER BY ts, event_id))::INT AS "Part" FROM b"""


@query(_break_sql("abs(t - lag(t) OVER w) >= 3600"))
def break_gap(t):
    return P.break_at_gap(t.event_pages, "t", 3600.0).rows.select("event_id", "Part")


@query(_break_sql("value > lag(value) OVER w"))
def break_increase(t):
    return P.break_at_increase(t.event_pages, "value").rows.select("event_id", "Part")


@query(_break_sql("lag(value) OVER w - value >= 30"))
def break_decrease(t):
    return P.break_at_increase(t.event_pages, "value", 30.0, decrease=True).rows.select("event_id", "Part")


@query(_break_sql("trunc((t - 0) / 86400) <> trunc((lag(t) OVER w - 0) / 86400)"))
def break_change(t):
    return P.break_at_change(t.event_pages, "t", 86400.0, 0.0).rows.select("event_id", "Part")


@query(_break_sql("user_id = 7 AND row_number() OVER w > 1"))
def break_match(t):
    return P.break_at_match(t.event_pages, F.col("user_id") == 7).rows.select("event_id", "Part")


@query(f"""WITH s AS (SELECT event_id, {_R} AS r, {_N} AS n FROM events), p AS (SELECT *, CASE WHEN n <= 100 THEN 1 ELSE ceil((n - 100) / 80.0)::INT + 1 END AS pages FROM s)
SELECT event_id, unnest(range(greatest(0, ceil((r - 99) / 80.0)::INT), least(r // 80, pages - 1)::INT + 1))::INT AS "Part" FROM p""")
def break_row_limit(t):
    return P.break_by_rows(t.event_pages, 100, 20).rows.select("event_id", "Part")


@query(f"SELECT event_id, floor(({_R}) * 4 / {_N})::INT AS \"Part\" FROM events")
def break_pieces(t):
    return P.break_in_pieces(t.event_pages, 4).rows.select("event_id", "Part")


@query(f'WITH {_EQUAL} SELECT i::INT AS "NewPage", page, c_custkey FROM e')
def regroup_pages(t):
    return P.regroup(_equal_pages(t)).rows.select("NewPage", "page", "c_custkey")


@query("""SELECT c_mktsegment, R(avg(c_acctbal)) AS mean, row_number() OVER (ORDER BY c_mktsegment)::INT AS "PageNumber" FROM customer GROUP BY 1""")
def collapse_pages(t):
    p = t.customer_pages
    return P.collapse(type(p)(p.rows, p.page, p.order, p.rows.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"))))


@query("""SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS "PageNumber", n_name FROM nation""")
def expand_rows(t):
    return P.expand(paged(t.nation, "n_regionkey", "n_nationkey")).params.select("n_regionkey", "PageNumber", "n_name")


@query("""SELECT s_suppkey, 0 AS "Page", 's_acctbal' AS "vName", s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 1, 's_nationkey', s_nationkey FROM supplier""")
def separate_columns(t):
    return P.separate(t.supplier, {"v": ["s_acctbal", "s_nationkey"]}, ["s_suppkey"])


@query("""SELECT s_suppkey, 'a' AS "Rootname", s_acctbal AS "Bal" FROM supplier UNION ALL SELECT s_suppkey, 'b', s_acctbal * 2 FROM supplier""")
def collect_columns(t):
    df = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("aBal"), (F.col("s_acctbal") * 2).alias("bBal"))
    return P.collect(df, "Bal", ["s_suppkey"])


@query("""SELECT 'mean' AS "OldColumnNames", R(avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING')) AS "BUILDING", R(avg(c_acctbal) FILTER (WHERE c_mktsegment = 'FURNITURE')) AS "FURNITURE" FROM customer
UNION ALL SELECT 'top', max(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), max(c_acctbal) FILTER (WHERE c_mktsegment = 'FURNITURE') FROM customer""")
def transpose_matrix(t):
    m = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "FURNITURE")).groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("top"))
    return P.transpose(m, "c_mktsegment", ["mean", "top"])


@query("""SELECT s_name, 's_acctbal' AS "Rootname", s_acctbal AS "Data" FROM supplier UNION ALL SELECT s_name, 's_nationkey', s_nationkey FROM supplier""")
def matrix_to_column(t):
    return P.matrix_to_column(t.supplier, "s_name", ["s_acctbal", "s_nationkey"])


@query("""SELECT vec_id, R(embedding[i * 8 + 3 + 1]) AS "Value", i::BIGINT AS "Index1" FROM embeddings, range(8) r(i)""")
def array_to_column(t):
    return P.array_to_column(t.embeddings, "embedding", ["vec_id"], (8, 8), {1: 3}).select("vec_id", F.col("Value").cast("double").alias("Value"), F.col("Index1").cast("bigint"))


@query(f"""WITH {TIMED} SELECT event_id, n_name, R(lead(t) OVER (PARTITION BY n_name ORDER BY t) - t) AS "Duration" FROM t JOIN nation ON n_nationkey = user_id % 25""")
def alarm_durations(t):
    df = t.timed.withColumn("n_nationkey", F.col("user_id") % 25)
    return P.alarm_durations(df, t.nation, "n_nationkey", "n_name", "t").select("event_id", "n_name", "Duration")


@query(SQL["derivative"])
def derivative_in_blocks(t):
    """The pages of events in blocks of 1,024 rows, of which they have many at each size."""
    p = blocks.in_blocks(t.event_pages, lambda q: O.derivative(q, "value", "t"), 1, 1024)
    return p.rows.select("event_id", "valueDeriv", "valueDerivPosition")


@query(SQL["smooth_boxcar"])
def smooth_in_blocks(t):
    return blocks.in_blocks(t.event_pages, lambda q: O.smooth(q, "value", 5, 2), 4, 1024).rows.select("event_id", "value")


@query(SQL["cumulative_integral"])
def integral_in_blocks(t):
    return blocks.cumulative_integral(t.event_pages, "value", "t", "i", 1024).rows.select("event_id", "i")
