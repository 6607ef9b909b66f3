"""Reductions, envelopes, histograms, correlations and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.frame import paged
from quire.operators import aggregates as A
from quire.operators import reductions as R
from quire.plans.registry import TIMED, query

_ORDERED = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events"


@query("""SELECT event_type, R(avg(value)) AS "valueAverage", R(sum(value)) AS "valueSum", R(sqrt(avg(value * value))) AS "valueRms",
R(stddev_samp(value)) AS "valueStandarddeviation", R(stddev_samp(value) / sqrt(count(value))) AS "valueSigma", count(value) AS "valueCount" FROM events GROUP BY 1""")
def process_moments(t):
    return R.reduce(t.event_pages, "value", ["average", "sum", "rms", "standarddeviation", "sigma", "count"])


@query("""SELECT c_mktsegment, R(min(c_acctbal)) AS "c_acctbalMinimum", R(max(c_acctbal)) AS "c_acctbalMaximum", R(min(abs(c_acctbal))) AS "c_acctbalSmallest",
R(max(abs(c_acctbal))) AS "c_acctbalLargest", R(max(c_acctbal) - min(c_acctbal)) AS "c_acctbalSpread" FROM customer GROUP BY 1""")
def process_extremes(t):
    return R.reduce(t.customer_pages, "c_acctbal", ["minimum", "maximum", "smallest", "largest", "spread"])


@query("SELECT n_regionkey, R(product(n_nationkey + 1)) AS p FROM nation GROUP BY 1")
def process_product(t):
    p = paged(t.nation.withColumn("p", F.col("n_nationkey") + 1), "n_regionkey", "n_nationkey")
    return R.reduce(p, "p", ["product"], prefix="p").withColumnRenamed("pProduct", "p")


@query("SELECT event_type, R(sum(user_id * value) / sum(user_id)) AS average, R(sqrt(sum(user_id * value * value) / sum(user_id))) AS rms, R(sum(user_id * value)) AS sum FROM events GROUP BY 1")
def process_weighted(t):
    return t.event_pages.reduce(*[c.alias(n) for n, c in R.weighted("value", "user_id").items()])


@query("""WITH m AS (SELECT event_type AS e, sum(user_id * value) / sum(user_id) AS m FROM events GROUP BY 1)
SELECT event_type, R(sqrt(sum(user_id * pow(value - m, 2)) * count(*) / (sum(user_id) * (count(*) - 1)))) AS sd FROM events JOIN m ON e = event_type GROUP BY 1""")
def process_weighted_deviation(t):
    return R.weighted_deviation(t.event_pages, "value", "user_id", "sd")


@query("WITH m AS (SELECT event_type AS e, avg(value) AS m FROM events GROUP BY 1) SELECT event_type, R(avg(abs(value - m))) AS mad FROM events JOIN m ON e = event_type GROUP BY 1")
def process_mad(t):
    return R.mean_absolute_deviation(t.event_pages, "value", "mad")


@query(f"""WITH o AS ({_ORDERED}) SELECT event_type, max(value) FILTER (WHERE k = n // 2) AS median, max(value) FILTER (WHERE k = floor((n - 1) * 0.9)) AS p90,
max(value) FILTER (WHERE k = floor((n - 1) * 0.05)) AS p5 FROM o GROUP BY 1""")
def process_percentiles(t):
    return R.order_statistics(t.event_pages, "value", {"median": "median", "p90": 90.0, "p5": 5.0})


@query(f"""WITH o AS ({_ORDERED}) SELECT event_type, R(max(value) FILTER (WHERE k = floor((n - 1) * 0.75)) - max(value) FILTER (WHERE k = floor((n - 1) * 0.25))) AS q FROM o GROUP BY 1""")
def process_qrange(t):
    return R.percentile_range(t.event_pages, "value", 25, 75, "q")


@query(f"""WITH o AS ({_ORDERED}) SELECT event_type, R(max(value) FILTER (WHERE k = floor((n - 1) * 0.9)) - max(value) FILTER (WHERE k = floor((n - 1) * 0.1))) AS d FROM o GROUP BY 1""")
def process_drange(t):
    return R.percentile_range(t.event_pages, "value", 10, 90, "d")


@query("SELECT event_type, arg_max(user_id, (value, -epoch_us(ts))) AS u FROM events GROUP BY 1")
def process_position(t):
    return R.extreme_position(t.event_pages, "value", "user_id", "maximum", "u")


@query("SELECT c_mktsegment, R(arg_max(c_acctbal, (abs(c_acctbal), -c_custkey))) AS v FROM customer GROUP BY 1")
def process_signed_largest(t):
    return R.signed_extreme(t.customer_pages, "c_acctbal", "largest", "v")


@query("SELECT c_mktsegment, R(arg_min(c_acctbal, (abs(c_acctbal), c_custkey))) AS v FROM customer GROUP BY 1")
def process_signed_smallest(t):
    return R.signed_extreme(t.customer_pages, "c_acctbal", "smallest", "v")


@query("SELECT event_type, arg_min(event_id, (ts, event_id)) AS f, arg_max(event_id, (ts, event_id)) AS l FROM events GROUP BY 1")
def process_first_last(t):
    return R.first_last(t.event_pages, "event_id", "f", "l")


@query("""WITH e AS (SELECT event_type, value, min(value) OVER w AS lo, (max(value) OVER w - min(value) OVER w) / 98 AS d FROM events WINDOW w AS (PARTITION BY event_type)),
b AS (SELECT event_type, floor((value - lo) / d + 1) AS b, count(*) AS c, any_value(lo) AS lo, any_value(d) AS d FROM e GROUP BY 1, 2)
SELECT event_type, R(arg_max(lo + (b - 0.5) * d, (c, -b))) AS m FROM b GROUP BY 1""")
def process_mode(t):
    return R.mode(t.event_pages, "value", "m")


@query(f"""WITH {TIMED} SELECT event_type, R(regr_slope(value, t) * 1e6) AS "vSlope", R(regr_intercept(value, t)) AS "vIntercept",
R(sqrt(regr_syy(value, t) - regr_sxy(value, t) * regr_slope(value, t)) / sqrt(count(*) - 2)) AS "vLfsd" FROM t GROUP BY 1""")
def process_line(t):
    return R.line(t.event_pages, "value", "t", "v").withColumn("vSlope", F.col("vSlope") * 1e6)


@query(f"WITH {TIMED} SELECT event_type, R(corr(value, t)) AS r FROM t GROUP BY 1")
def process_correlation(t):
    return R.correlation(t.event_pages, "value", "t", "r")


@query(f"""WITH {TIMED}, s AS (SELECT event_type, (value + lag(value) OVER w) * (t - lag(t) OVER w) / 2 AS a FROM t WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_type, R(sum(a)) AS a FROM s GROUP BY 1""")
def process_integral(t):
    return R.integral(t.event_pages, "value", "t", "a")


@query("""WITH s AS (SELECT c_mktsegment, c_custkey, c_acctbal AS y, c_custkey AS x, lag(c_acctbal) OVER w AS y0, lag(c_custkey) OVER w AS x0 FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey))
SELECT c_mktsegment, R(arg_min(CASE WHEN y = y0 THEN x0 ELSE x0 - y0 * (x - x0) / (y - y0) END, c_custkey)) AS z FROM s WHERE (y0 <= 0 AND y >= 0) OR (y0 >= 0 AND y <= 0) GROUP BY 1""")
def process_zero_crossing(t):
    return R.zero_crossing(t.customer_pages, "c_acctbal", "c_custkey", "z")


@query(f"""WITH {TIMED}, k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n FROM t WHERE t >= 1e5 AND t <= 2e6 AND value <= 80 AND value >= 1 WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS j FROM k WHERE i <= 500)
SELECT event_type, R(avg((value + 2) * 3)) AS "valueAverage", count(value) AS "valueCount", R(max((value + 2) * 3)) AS "valueMaximum" FROM h WHERE j > 7 GROUP BY 1""")
def process_qualified(t):
    q = R.qualified(t.event_pages, "value", function_of="t", lower=1e5, upper=2e6, top=80.0, bottom=1.0, head=500, tail=-7, offset=2.0, factor=3.0)
    return R.reduce(q, "value", ["average", "count", "maximum"])


@query("""WITH p AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer), m AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM p WHERE c_name LIKE '%7%'),
h AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) AS j FROM m WHERE i <= floor(abs(n * 0.15 + 0.5))) SELECT c_mktsegment, R(sum(c_acctbal)) AS "c_acctbalSum", count(*) AS "c_acctbalCount" FROM h WHERE j <= floor(abs(n * 0.1 + 0.5)) GROUP BY 1""")
def process_matching_fraction(t):
    q = R.qualified(t.customer_pages, "c_acctbal", match=("c_name", "*7*"), fhead=0.15, ftail=0.1)
    return R.reduce(q, "c_acctbal", ["sum", "count"])


@query("""SELECT c_nationkey, R(coalesce(max(c_acctbal) FILTER (WHERE c_acctbal > 9900), -1)) AS "c_acctbalMaximum", count(*) FILTER (WHERE c_acctbal > 9900) AS "c_acctbalCount" FROM customer GROUP BY 1""")
def process_default(t):
    p = paged(t.customer, "c_nationkey", "c_custkey")
    return R.with_default(p, R.reduce(p.keep(F.col("c_acctbal") > 9900), "c_acctbal", ["maximum", "count"]), -1.0)


@query(f"""WITH o AS ({_ORDERED}) SELECT event_type, R(max(value) FILTER (WHERE k = floor((n - 1) * 0.8)) - max(value) FILTER (WHERE k = floor((n - 1) * 0.3))) AS v FROM o GROUP BY 1""")
def process_prange(t):
    return R.percentile_range(t.event_pages, "value", 30, 80, "v")


@query()
def process_pulse(t):
    p = paged(t.timed.withColumn("pulse", F.exp(-F.pow((F.col("t") - 1.2e6) / 3e5, F.lit(2))) * 100), "event_type", ("ts", "event_id"))
    return R.pulse(p, "pulse", "t")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS "Row" FROM events)
SELECT "Row", R(max(value)) AS "valueMax", R(min(value)) AS "valueMin", R(avg(value)) AS "valueMean", R(stddev_samp(value)) AS "valueStDev", R(sqrt(avg(value * value))) AS "valueRms",
R(stddev_samp(value) / sqrt(count(value))) AS "valueSigma", R(max(abs(value))) AS "valueLargest",
R(CASE WHEN count(value) > 2 THEN (sum(value) - max(value) - min(value)) / (count(value) - 2) ELSE 0 END) AS "valueExmmMean" FROM r GROUP BY 1""")
def envelope(t):
    return A.envelope(t.event_pages, ["value"], ["Max", "Min", "Mean", "StDev", "Rms", "Sigma", "Largest", "ExmmMean"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS "Row" FROM events), o AS (SELECT "Row", value, row_number() OVER (PARTITION BY "Row" ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY "Row") AS n FROM r)
SELECT "Row", R(max(value) FILTER (WHERE k = n // 2)) AS "valueMedian", R(max(value) FILTER (WHERE k = floor((n - 1) * 0.9)) - max(value) FILTER (WHERE k = floor((n - 1) * 0.1))) AS "valueDRange", R(max(value) FILTER (WHERE k = floor((n - 1) * 0.6))) AS "valuePercentile60", R(max(value)) AS "valueMax" FROM o GROUP BY 1""")
def envelope_order_statistics(t):
    return A.envelope(t.event_pages, ["value"], ["Median", "DRange", "Percentile60", "Max"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS "Row" FROM events)
SELECT "Row", R(sum(value * value)) AS "value2Sum" FROM r GROUP BY 1""")
def envelope_power_sum(t):
    return A.envelope(t.event_pages, ["value"], ["Sum"], power=2)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS "Row" FROM events), w AS (SELECT *, user_id * 1.37::DOUBLE + 0.11::DOUBLE AS w FROM r)
SELECT "Row", R(sum(w * value) / sum(w)) AS "valueWMean", R(sqrt(sum(w * value * value) / sum(w))) AS "valueWRms" FROM w GROUP BY 1""")
def envelope_weighted(t):
    p = paged(t.events.withColumn("w", F.col("user_id") * 1.37 + 0.11), "event_type", ("ts", "event_id"))
    return A.envelope(p, ["value"], ["WMean", "WRms"], weight="w")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS "Row" FROM events)
SELECT "Row", arg_max(user_id, (value, event_type)) AS "user_idCMaximumvalue" FROM r GROUP BY 1""")
def envelope_partner(t):
    return A.extreme_partner(t.event_pages, "value", "user_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS "Row" FROM customer)
SELECT c_mktsegment, "Row", R(max(c_acctbal)) AS "c_acctbalMax", R(avg(c_acctbal)) AS "c_acctbalMean", R(CASE WHEN count(DISTINCT c_nationkey) > 1 THEN regr_slope(c_acctbal, c_nationkey) END) AS "c_acctbalSlope" FROM r GROUP BY 1, 2""")
def grouped_envelope(t):
    p = paged(t.customer, ("c_mktsegment", "c_nationkey"), "c_custkey")
    return A.envelope(p, ["c_acctbal"], ["Max", "Mean", "Slope"], group=["c_mktsegment"], x="c_nationkey")


@query("""WITH v AS (SELECT *, [l_quantity, l_discount * 100, l_tax * 100, l_linenumber::DOUBLE] AS a FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)),
w AS (SELECT *, list_filter(a, lambda x: x >= 1) AS f FROM v)
SELECT l_orderkey, l_linenumber, l_quantity, len(f)::INT AS "RowCount", R(list_sum(f)) AS "RowSum", R(list_avg(f)) AS "RowMean", R(list_min(f)) AS "RowMin", R(list_max(f)) AS "RowMax", R(list_max(f) - list_min(f)) AS "RowSpread",
R(list_stddev_samp(f)) AS "RowStDev", R(list_sort(f)[len(f) // 2 + 1]) AS "RowMedian", R(list_sort(f)[floor((len(f) - 1) * 0.9)::INT + 1] - list_sort(f)[floor((len(f) - 1) * 0.1)::INT + 1]) AS "RowDRange",
R(list_sort(f)[floor((len(f) - 1) * 0.4)::INT + 1]) AS "RowPercentile40" FROM w""")
def row_statistics(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").distinct()
    df = df.withColumn("d", F.col("l_discount") * 100).withColumn("x", F.col("l_tax") * 100)
    out = A.row_statistics(df, ["l_quantity", "d", "x", "l_linenumber"], low=1.0, percentiles=[40.0])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "RowCount", "RowSum", "RowMean", "RowMin", "RowMax", "RowSpread", "RowStDev", "RowMedian", "RowDRange", "RowPercentile40")


_EDGES = "SELECT event_type, min(value) - 1e-7 * (max(value) - min(value)) AS lo, max(value) + 1e-7 * (max(value) - min(value)) AS hi FROM events GROUP BY 1"


@query(f"""WITH e AS (SELECT *, (hi - lo) / 20 AS d FROM ({_EDGES})), b AS (SELECT event_type, floor((value - lo) / d) AS b, count(*)::DOUBLE AS f FROM events JOIN e USING (event_type) GROUP BY 1, 2),
g AS (SELECT event_type, lo, d, unnest(range(20)) AS b FROM e), j AS (SELECT g.event_type, lo, d, g.b, coalesce(f, 0) AS f FROM g LEFT JOIN b ON g.event_type = b.event_type AND g.b = b.b)
SELECT event_type, R(lo + (b + 0.5) * d) AS value, f AS frequency, R(sum(f) OVER (PARTITION BY event_type ORDER BY b) / sum(f) OVER (PARTITION BY event_type)) AS "valueCdf" FROM j""")
def histogram(t):
    return A.histogram(t.event_pages, "value")


@query("""WITH m AS (SELECT event_type, (min(value) + max(value)) / 2 AS m, max(value) - min(value) + 2.5 AS s FROM events GROUP BY 1), e AS (SELECT event_type, m - s / 2 AS lo, floor(s / 2.5 + 0.5)::BIGINT AS n FROM m),
b AS (SELECT event_type, floor((value - lo) / 2.5) AS b, count(*)::DOUBLE AS f FROM events JOIN e USING (event_type) GROUP BY 1, 2), g AS (SELECT event_type, lo, unnest(range(n)) AS b FROM e), j AS (SELECT g.event_type, lo, g.b, coalesce(f, 0) AS f FROM g LEFT JOIN b ON g.event_type = b.event_type AND g.b = b.b)
SELECT event_type, R(lo + (b + 0.5) * 2.5) AS value, f AS frequency, R(sum(f) OVER (PARTITION BY event_type ORDER BY b) / sum(f) OVER (PARTITION BY event_type)) AS "valueCdf" FROM j""")
def histogram_bin_size(t):
    return A.histogram(t.event_pages, "value", size=2.5)


@query("""WITH b AS (SELECT c_mktsegment, floor((c_acctbal - 0) / 1000) AS b, sum(c_nationkey)::DOUBLE AS f FROM customer WHERE c_nationkey > 3 AND c_acctbal >= 0 AND c_acctbal < 10000 GROUP BY 1, 2),
g AS (SELECT c_mktsegment, unnest(range(10)) AS b FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey > 3)), j AS (SELECT g.c_mktsegment, g.b, coalesce(f, 0) AS f FROM g LEFT JOIN b ON g.c_mktsegment = b.c_mktsegment AND g.b = b.b)
SELECT c_mktsegment, R((b + 0.5) * 1000) AS c_acctbal, R(f / sum(f) OVER (PARTITION BY c_mktsegment)) AS frequency, R(sum(f) OVER (PARTITION BY c_mktsegment ORDER BY b) / sum(f) OVER (PARTITION BY c_mktsegment)) AS "c_acctbalCdf" FROM j""")
def histogram_weighted(t):
    return A.histogram(t.customer_pages, "c_acctbal", 10, 0.0, 10000.0, weight="c_nationkey", gate=F.col("c_nationkey") > 3, normalize="sum")


@query("SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'middle' ELSE 'high' END AS \"Region\", count(*) AS frequency FROM events GROUP BY 1")
def histogram_regions(t):
    return A.region_histogram(t.events, "value", [10.0, 100.0], ["low", "middle", "high"])


@query("""WITH u AS (SELECT l_returnflag, 'q' AS c, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'n', l_linenumber FROM lineitem),
b AS (SELECT l_returnflag, floor((x - 0) / 5) AS b, c FROM u WHERE x >= 0 AND x < 60)
SELECT l_returnflag, R((b + 0.5) * 5) AS x, count(*) FILTER (WHERE c = 'q')::DOUBLE AS "l_quantityFrequency", count(*) FILTER (WHERE c = 'n')::DOUBLE AS "l_linenumberFrequency" FROM b GROUP BY l_returnflag, b""")
def histogram_several(t):
    return A.multi_histogram(paged(t.lineitem, "l_returnflag", "l_orderkey"), ["l_quantity", "l_linenumber"], 12, 0.0, 60.0)


@query("""WITH b AS (SELECT event_type, floor(value / 10) AS b FROM events WHERE value >= 0 AND value < 200),
c AS (SELECT b, count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS v, count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS k FROM b GROUP BY 1)
SELECT R((b + 0.5) * 10) AS value, v AS "viewFrequency", k AS "clickFrequency", least(v, k) AS "click.viewOverlap" FROM c""")
def histogram_by_event(t):
    return A.event_histogram(t.events, "value", "event_type", ["view", "click"], 20, 0.0, 200.0, overlap="view")


@query("""WITH b AS (SELECT floor(l_quantity / 10) AS i, floor(l_discount / 0.025) AS j, count(*)::DOUBLE AS f FROM lineitem GROUP BY 1, 2), g AS (SELECT i, j FROM range(6) a(i), range(5) b(j))
SELECT R((g.i + 0.5) * 10) AS l_quantity, R((g.j + 0.5) * 0.025) AS l_discount, coalesce(f, 0) AS frequency FROM g LEFT JOIN b ON g.i = b.i AND g.j = b.j""")
def histogram_2d(t):
    return A.histogram_2d(t.lineitem, "l_quantity", "l_discount", (6, 5), (0.0, 60.0), (0.0, 0.125))


@query("""WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, 'l_quantity' AS "Correlate1Name", 'l_extendedprice' AS "Correlate2Name", 'l_quantity.l_extendedprice' AS "CorrelatePair", R(a) AS "CorrelationCoefficient", n AS "CorrelationPoints" FROM c
UNION ALL SELECT l_returnflag, 'l_quantity', 'l_discount', 'l_quantity.l_discount', R(b), n FROM c UNION ALL SELECT l_returnflag, 'l_extendedprice', 'l_discount', 'l_extendedprice.l_discount', R(c), n FROM c""")
def correlations(t):
    return A.correlations(paged(t.lineitem, "l_returnflag", "l_orderkey"), ["l_quantity", "l_extendedprice", "l_discount"])


#: Two-tailed probability of r among n points, by the finite series of Student's law, of even and of odd degrees of freedom.
_SIGNIFICANCE = """CASE WHEN n % 2 = 0 THEN 1 - abs(r) * list_sum(list_transform(range((n - 2) // 2), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) * pow(1 - r * r, k)))
ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * list_sum(list_transform(range((n - 3) // 2), lambda k: exp(lgamma(k + 1.0::DOUBLE) + lgamma(1.5::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * pow(1 - r * r, k)))) END"""


@query(f"""WITH x AS (SELECT c_nationkey, c_acctbal AS a, c_custkey::DOUBLE AS b, (c_custkey % 7)::DOUBLE AS c FROM customer),
l AS (SELECT c_nationkey, 'a' AS p, 'b' AS q, a AS u, b AS v FROM x UNION ALL SELECT c_nationkey, 'a', 'c', a, c FROM x UNION ALL SELECT c_nationkey, 'b', 'c', b, c FROM x), m AS (SELECT c_nationkey, p, q, corr(u, v) AS r, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT c_nationkey, p AS "Correlate1Name", q AS "Correlate2Name", p || '.' || q AS "CorrelatePair", R(r) AS "CorrelationCoefficient", n AS "CorrelationPoints", R({_SIGNIFICANCE}) AS "CorrelationSignificance" FROM m""")
def correlations_significance(t):
    rows = t.customer.select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("a"), F.col("c_custkey").cast("double").alias("b"), (F.col("c_custkey") % 7).cast("double").alias("c"))
    return A.correlations(paged(rows, "c_nationkey", "c_custkey"), ["a", "b", "c"], significance=True)


@query("""WITH o AS (SELECT event_type, value AS a, user_id AS b, avg(value) OVER w AS ma, stddev(value) OVER w AS sa, avg(user_id) OVER w AS mb, stddev(user_id) OVER w AS sb FROM events WINDOW w AS (PARTITION BY event_type)),
k AS (SELECT event_type, a, b FROM o WHERE abs(a - ma) <= 1.5 * sa AND abs(b - mb) <= 1.5 * sb) SELECT event_type, 'value' AS "Correlate1Name", 'user_id' AS "Correlate2Name", 'value.user_id' AS "CorrelatePair", R(corr(a, b)) AS "CorrelationCoefficient", count(*) AS "CorrelationPoints" FROM k GROUP BY 1""")
def correlations_without_outliers(t):
    return A.correlations(t.event_pages, ["value", "user_id"], outlier=1.5)


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0::DOUBLE AS b FROM events)
SELECT event_type, 'value' AS "Correlate1Name", 'user_id' AS "Correlate2Name", 'value.user_id' AS "CorrelatePair", R(corr(a, b)) AS "CorrelationCoefficient", count(*) AS "CorrelationPoints" FROM r GROUP BY 1""")
def rank_correlations(t):
    return A.correlations(t.event_pages, ["value", "user_id"], rank=True)


@query("""WITH s AS (SELECT event_type, value AS x, unnest([-2, 0, 3]) AS s, user_id, ts, event_id FROM events), l AS (SELECT event_type, x, s,
CASE s WHEN -2 THEN lead(user_id, 2) OVER w WHEN 3 THEN lag(user_id, 3) OVER w ELSE user_id END AS y FROM s WINDOW w AS (PARTITION BY event_type, s ORDER BY ts, event_id))
SELECT event_type, s AS "ShiftAmount", R(corr(x, y)) AS "valueShiftedCor" FROM l GROUP BY 1, 2""")
def shift_correlation(t):
    return A.shift_correlation(t.event_pages, "value", "user_id", [-2, 0, 3])


@query(f"""WITH {TIMED}, f AS (SELECT event_type, count(*)::DOUBLE AS n, regr_slope(value, t / 1e5) AS b, regr_intercept(value, t / 1e5) AS a, regr_sxx(value, t / 1e5) AS sxx, avg(t / 1e5) AS m, regr_syy(value, t / 1e5) AS syy, regr_sxy(value, t / 1e5) AS sxy FROM t GROUP BY 1),
c AS (SELECT *, (syy - sxy * b) / (n - 2) AS c FROM f)
SELECT event_type, R(b) AS "valueSlope", R(a) AS "valueIntercept", R(sqrt(c / sxx)) AS "valueSlopeSigma", R(sqrt(c * (1 / n + m * m / sxx))) AS "valueInterceptSigma", R(c) AS "valueChiSquared" FROM c""")
def slopes(t):
    p = paged(t.timed.withColumn("x", F.col("t") / 1e5), "event_type", ("ts", "event_id"))
    return A.slopes(p, "x", ["value"])


@query("SELECT c_mktsegment, R(regr_slope(c_acctbal, c_nationkey)) AS \"c_acctbalSlope\", R(regr_intercept(c_acctbal, c_nationkey)) AS \"c_acctbalIntercept\" FROM customer GROUP BY 1")
def slopes_across_pages(t):
    return A.slopes_across_pages(paged(t.customer, "c_nationkey", "c_custkey"), "c_nationkey", ["c_acctbal"], "c_mktsegment")


@query("SELECT c_nationkey, R(sqrt(avg(pow(c_acctbal, 2)))) AS c_acctbal FROM customer GROUP BY 1")
def field_average(t):
    return A.field_average(t.customer, ["c_nationkey"], "c_acctbal", 2)


@query()
def distribution_test(t):
    return A.ks_statistic(t.event_pages, "value", 50.0, 50.0)


@query("""SELECT event_type, g::DOUBLE AS value, R(avg(exp(-pow((value - g) / 10, 2) / 2)) / (10 * sqrt(2 * pi()))) AS "valuePDF" FROM events, (SELECT unnest([0, 25, 50, 100]) AS g) GROUP BY 1, 2""")
def kernel_density(t):
    return A.density(t.event_pages, "value", 10.0, [0, 25, 50, 100])


@query("""SELECT gx::DOUBLE AS l_quantity, gy::DOUBLE AS l_discount, R(avg(exp(-(pow((l_quantity - gx) / 5, 2) + pow((l_discount - gy) / 0.01, 2)) / 2)) / (5 * 0.01 * 2 * pi())) AS "PDF"
FROM lineitem, (SELECT * FROM (VALUES (10.0, 0.02), (25.0, 0.05)) v(gx, gy)) GROUP BY 1, 2""")
def kernel_density_2d(t):
    return A.density_2d(t.lineitem, "l_quantity", "l_discount", (5.0, 0.01), [(10.0, 0.02), (25.0, 0.05)])


@query("""SELECT a.c_custkey, (SELECT count(*) FROM customer b WHERE b.c_mktsegment = a.c_mktsegment AND b.c_acctbal BETWEEN a.c_acctbal - 100 AND a.c_acctbal + 100) AS "LocalDensity" FROM customer a""")
def local_density(t):
    return A.local_density(t.customer_pages, "c_acctbal", 100.0).rows.select("c_custkey", "LocalDensity")


@query("""WITH s AS (SELECT c_custkey, c_mktsegment, (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) AS u FROM customer WINDOW w AS (PARTITION BY c_mktsegment))
SELECT a.c_custkey, (SELECT count(*) FROM s b WHERE b.c_mktsegment = a.c_mktsegment AND b.u BETWEEN a.u - 0.02 AND a.u + 0.02) AS "LocalDensity" FROM s a""")
def local_density_fraction(t):
    return A.local_density(t.customer_pages, "c_acctbal", 0.02, fraction=True).rows.select("c_custkey", "LocalDensity")
