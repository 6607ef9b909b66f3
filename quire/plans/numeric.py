"""Signals, fits, matrices and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.frame import paged
from quire.operators import fits, images, matrices, signal
from quire.operators.blocks import numbered_in_chunks
from quire.plans.registry import TIMED, query


def _wave(t):
    """A page of 400 samples per customer segment: a sum of two sines on a slope."""
    rows = t.spark.range(1200).select(F.floor(F.col("id") / 400).alias("page"), ((F.col("id") % 400) / 100).alias("x"))
    return paged(rows.withColumn("y", 3 + F.sin(2 * 3.141592653589793 * 5 * F.col("x") + F.col("page")) + 0.3 * F.cos(2 * 3.141592653589793 * 12 * F.col("x"))), "page", "x")


def _balances(t):
    """A page of customers' balances per nation."""
    return paged(t.customer, "c_nationkey", "c_custkey").numbered("i")


def _near(fitted):
    """Parameters to three decimals, widths without their sign: what a descent settles at, not its last digits."""
    out = fitted.drop("RmsResidual")
    return out.select(*[(F.abs(F.round(c, 3)) if c in ("gfitSigma", "lfitGamma") else F.round(c, 3)).alias(c) if k == "double" else c for c, k in out.dtypes])


_N = "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1"


def _whole(padding=1):
    """SQL: balances v of a nation, their places i and the whole transform z of v, padded to n; _BACK is the inverse one."""
    return f"""s AS (SELECT c_nationkey AS g, c_acctbal AS v, {_N} AS i, {padding} * count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
k AS (SELECT g, n, unnest(range(n)) AS k FROM s GROUP BY g, n), z AS (SELECT k.g, k.n, k.k, sum(v * cos(2 * pi() * ((k * i) % k.n) / k.n)) AS re, -sum(v * sin(2 * pi() * ((k * i) % k.n) / k.n)) AS im FROM k JOIN s ON k.g = s.g GROUP BY 1, 2, 3)"""


_WHOLE = _whole()
_BACK = "sum(re * cos(2 * pi() * ((k * i) % s.n) / s.n) - im * sin(2 * pi() * ((k * i) % s.n) / s.n)) / s.n"


@query(f"""WITH s AS (SELECT c_nationkey, c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS v, {_N} AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), k AS (SELECT c_nationkey AS g, unnest(range(max(n) // 2 + 1)) AS k, max(n) AS m FROM s GROUP BY 1),
z AS (SELECT g, k, m, sum(v * cos(2 * pi() * ((k * i) % m) / m)) / m AS re, sum(v * sin(2 * pi() * ((k * i) % m) / m)) / m AS im FROM k JOIN s ON g = c_nationkey GROUP BY 1, 2, 3)
SELECT g AS c_nationkey, R(k / m) AS f, R(sqrt(re * re + im * im) * CASE WHEN k = 0 OR 2 * k = m THEN 1 ELSE 2 END) AS "FFTc_acctbal" FROM z""")
def fourier_transform(t):
    return signal.fft(_balances(t), "i", "c_acctbal")


_SPECTRUM = f"""s0 AS (SELECT c_nationkey AS g, c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS v, {_N} AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
s AS (SELECT g, i, n, v * 0.5 * (1 - cos(2 * pi() * i / greatest(n - 1, 1))) AS v FROM s0), k AS (SELECT g, unnest(range(max(n) // 2 + 1)) AS k, max(n) AS m FROM s GROUP BY 1),
z AS (SELECT k.g, k, m, sum(v * cos(2 * pi() * ((k * i) % m) / m)) / m AS re, -sum(v * sin(2 * pi() * ((k * i) % m) / m)) / m AS im, CASE WHEN k = 0 OR 2 * k = m THEN 1 ELSE 2 END AS w FROM k JOIN s ON k.g = s.g GROUP BY 1, 2, 3),
q AS (SELECT g, k, m, re * w AS re, im * w AS im, (re * re + im * im) * w * w / CASE WHEN k = 0 THEN 1 ELSE 2 END * m AS psd FROM z)"""


@query(f"""WITH {_SPECTRUM} SELECT g AS c_nationkey, R(k / m) AS f, R(re) AS "RealFFTc_acctbal", R(im) AS "ImagFFTc_acctbal", R(psd) AS "PSDc_acctbal", R(sum(psd / m) OVER (PARTITION BY g ORDER BY k)) AS "IntegPSDc_acctbal" FROM q""")
def fourier_power(t):
    out = signal.fft(_balances(t), "i", "c_acctbal", window="hanning", psd=True, full=True)
    return out.select("c_nationkey", "f", "RealFFTc_acctbal", "ImagFFTc_acctbal", "PSDc_acctbal", "IntegPSDc_acctbal")


@query("""SELECT k::INT AS page, row_number() OVER (PARTITION BY k ORDER BY event_id) - 1 AS "Row", R(value * (k + 1)) AS value FROM events, range(2) r(k)""")
def fourier_inverse(t):
    """All events as two pages of one length, there and back."""
    rows = t.events.select("event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("page"), "value").withColumn("value", F.col("value") * (F.col("page") + 1))
    z = signal.fft(numbered_in_chunks(paged(rows, "page", "event_id"), "i"), "i", "value", subtract_mean=False, full=True, row="i")
    return signal.inverse_fft(paged(z, "page", "f"), "RealFFTvalue", "ImagFFTvalue", t.events.count(), row="i")


#: Components of an embedding.
_ALL = [f"c{i}" for i in range(64)]


def _vectors(t):
    """A page per label, its rows the whole embeddings."""
    return paged(t.embeddings.select("label", "vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_ALL)]), "label", "vec_id")


@query()
def fourier_2d(t):
    return signal.fft_2d(_vectors(t), _ALL)


@query("""SELECT event_id, R(value * 0.5 + coalesce(lag(value, 1) OVER w, 0) * 0.3 + coalesce(lag(value, 2) OVER w, 0) * 0.2) AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def convolution(t):
    return signal.convolve(t.event_pages, "value", [0.5, 0.3, 0.2], "c").rows.select("event_id", "c")


@query(f"""WITH {_whole(2)}, q AS (SELECT k.g, k.k, sum(exp(-0.5 * i) * cos(2 * pi() * ((k * i) % k.n) / k.n)) AS a, -sum(exp(-0.5 * i) * sin(2 * pi() * ((k * i) % k.n) / k.n)) AS b FROM k JOIN s ON k.g = s.g GROUP BY 1, 2),
m AS (SELECT *, greatest(a * a + b * b, 0.1 * max(a * a + b * b) OVER (PARTITION BY g)) AS p FROM q), d AS (SELECT g, k, (re * a + im * b) / p AS re, (im * a - re * b) / p AS im FROM z JOIN m USING (g, k))
SELECT s.g AS c_nationkey, i AS "Row", R({_BACK} / 0.25) AS d FROM s JOIN d ON s.g = d.g GROUP BY s.g, i, s.n""")
def deconvolution(t):
    p = _balances(t)
    return signal.deconvolve(p.with_rows(p.rows.withColumns({"r": F.exp(-0.5 * F.col("i")), "x": F.col("i") / 4})), "c_acctbal", "r", "d", noise=0.1, t="x")


@query(f"""WITH s AS (SELECT c_nationkey AS g, c_acctbal AS a, c_custkey % 7 AS b, {_N} AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), k AS (SELECT g, unnest(range(max(n))) AS k FROM s GROUP BY 1)
SELECT k.g AS c_nationkey, k AS "Row", R(0.5 * sum(x.a * y.b)) AS c FROM k JOIN s x ON x.g = k.g JOIN s y ON x.g = y.g AND (x.i = y.i - 2 + k) GROUP BY 1, 2""")
def cross_correlation(t):
    """The response begins two rows before 0."""
    p = _balances(t)
    return signal.correlate(p.with_rows(p.rows.withColumns({"r": F.col("c_custkey") % 7, "x": (F.col("i") - 2) / 2})), "c_acctbal", "r", "c", t="x")


@query("""WITH RECURSIVE s AS (SELECT c_nationkey AS g, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
f AS (SELECT g, i, v * 0.25 AS y FROM s WHERE i = 1 UNION ALL SELECT s.g, s.i, s.v * 0.25 + f.y * 0.75 FROM f JOIN s ON s.g = f.g AND s.i = f.i + 1) SELECT g AS c_nationkey, (i - 1)::DOUBLE AS i, R(y) AS "DigFilteredc_acctbal" FROM f""")
def digital_filter(t):
    return signal.digital_filter(paged(t.customer, "c_nationkey", "c_custkey").numbered("i"), "i", "c_acctbal", [([0.25], [1.0, -0.75])])


@query(f"""WITH {_WHOLE} SELECT s.g AS c_nationkey, i::DOUBLE AS i, R({_BACK}) AS low FROM s JOIN z ON s.g = z.g WHERE least(k, z.n - k) <= 0.2013 * z.n GROUP BY s.g, i, s.n""")
def frequency_filter(t):
    return signal.frequency_filter(_balances(t), "i", "c_acctbal", low=0.2013, name="low")


@query()
def frequency_analysis(t):
    return signal.naff(_wave(t), "x", "y", 2)


@query(f"""WITH s AS (SELECT c_nationkey AS g, c_acctbal AS v, {_N} AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
h AS (SELECT x.g, x.i, x.v, sum(CASE WHEN x.i = y.i THEN 0 WHEN x.n % 2 = 0 THEN CASE WHEN (x.i - y.i) % 2 = 0 THEN 0 ELSE 2.0 / x.n / tan(pi() * (x.i - y.i) / x.n) END
 ELSE (cos(pi() * (x.i - y.i) / x.n) - cos(pi() * (x.i - y.i))) / sin(pi() * (x.i - y.i) / x.n) / x.n END * y.v) AS im FROM s x JOIN s y ON x.g = y.g GROUP BY 1, 2, 3)
SELECT g AS c_nationkey, i::DOUBLE AS i, R(v) AS "Realc_acctbal", R(im) AS "Imagc_acctbal", R(sqrt(v * v + im * im)) AS "Magc_acctbal" FROM h""")
def analytic_signal(t):
    return signal.analytic_signal(_balances(t), "i", "c_acctbal").select("c_nationkey", "i", "Realc_acctbal", "Imagc_acctbal", "Magc_acctbal")


@query()
def layer_peeling(t):
    p = t.event_pages
    return signal.peel_impedance(p.with_rows(p.rows.withColumn("v", 0.2 + 0.0001 * F.col("value"))), "v", 1.0)


@query("""WITH p AS (SELECT c_mktsegment AS g, c_custkey::DOUBLE AS x, c_acctbal AS f, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey)),
d1 AS (SELECT *, (lead(f) OVER w - f) / (lead(x) OVER w - x) AS a FROM p WINDOW w AS (PARTITION BY g ORDER BY i)), d2 AS (SELECT *, (lead(a) OVER w - a) / (lead(x, 2) OVER w - x) AS b FROM d1 WINDOW w AS (PARTITION BY g ORDER BY i)),
d3 AS (SELECT *, (lead(b) OVER w - b) / (lead(x, 3) OVER w - x) AS c FROM d2 WINDOW w AS (PARTITION BY g ORDER BY i)), d4 AS (SELECT *, (lead(c) OVER w - c) / (lead(x, 4) OVER w - x) AS d FROM d3 WINDOW w AS (PARTITION BY g ORDER BY i)),
l AS (SELECT g, x, f, i, n, lag(f) OVER w AS f0, lead(f) OVER w AS f2, x - lag(x) OVER w AS h3, lag(x) OVER w - lag(x, 2) OVER w AS h2, lead(x) OVER w - x AS h4, a AS r1, lag(a) OVER w AS a1, lag(b) OVER w AS r2, lag(b, 2) OVER w AS b2, lag(c) OVER w AS c1, lag(c, 2) OVER w AS r3, CASE WHEN i > 2 THEN lag(d, 3) OVER w ELSE 0 END AS r4 FROM d4 WINDOW w AS (PARTITION BY g ORDER BY i)),
m AS (SELECT *, CASE WHEN i BETWEEN 2 AND n - 2 THEN pow(h3, 3) * (2 * h3 * h3 + 5 * (h3 * (h4 + h2) + 2 * h4 * h2)) / 120 END AS cc FROM l),
e AS (SELECT *, CASE WHEN i = 2 THEN 2 * cc - pow(h2, 3) * (h2 * (3 * h2 + 5 * h4) + 10 * h3 * (h2 + h3 + h4)) / 60 ELSE cc END AS s,
 CASE WHEN i = 1 THEN h3 * (f0 + h3 * (a1 / 2 - h3 * (r2 / 6 - (h3 + 2 * h4) * c1 / 12))) WHEN i BETWEEN 2 AND n - 2 THEN h3 * ((f + f0) / 2 - h3 * h3 * (b2 + r2 + (h2 - h4) * r3) / 12) ELSE 0 END AS step FROM m),
u AS (SELECT *, CASE WHEN i > 2 AND i <= n - 2 THEN (cc + lag(s) OVER (PARTITION BY g ORDER BY i)) * r4 ELSE 0 END AS er, h4 * (f2 - h4 * (r1 / 2 + h4 * (r2 / 6 + (2 * h3 + h4) * r3 / 12))) + s * r4 - pow(h4, 3) * r4 * (h4 * (3 * h4 + 5 * h2) + 10 * h3 * (h2 + h3 + h4)) / 60 AS last FROM e),
t AS (SELECT *, sum(step + er) OVER (PARTITION BY g ORDER BY i) AS total FROM u)
SELECT g AS c_mktsegment, x::BIGINT AS c_custkey, R(CASE WHEN i <= 2 THEN total ELSE lag(total) OVER w + lag(last) OVER w END / 1e3) AS "Integral" FROM t WINDOW w AS (PARTITION BY g ORDER BY i)""")
def gill_miller_integral(t):
    return signal.gill_miller(t.customer_pages, "c_custkey", "c_acctbal").rows.select("c_mktsegment", "c_custkey", (F.col("Integral") / 1e3).alias("Integral"))


#: A round settles the peaks that no earlier, unsettled one can still put out; then later ones put out those that they reach.
@query("""WITH RECURSIVE p AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, (epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6) AS t FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
d AS (SELECT 0 AS round, event_type, i, t, value, floor(0.0004 / 2 * n + 0.5)::BIGINT AS zone, NULL::BOOLEAN AS alive FROM p WHERE a <= value AND b <= value AND (a < value OR b < value)
UNION ALL SELECT round + 1, event_type, i, t, value, zone, CASE WHEN alive IS NOT NULL THEN alive WHEN max(value) FILTER (alive) OVER z >= value THEN false WHEN max(value) FILTER (alive IS NULL) OVER z >= value THEN NULL ELSE true END
FROM (SELECT *, bool_or(alive IS NULL) OVER () AS open FROM d) WHERE open WINDOW z AS (PARTITION BY event_type ORDER BY i RANGE BETWEEN zone PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(value) FILTER (alive) OVER (PARTITION BY event_type ORDER BY i RANGE BETWEEN 1 FOLLOWING AND zone FOLLOWING) AS later FROM d WHERE round = (SELECT max(round) FROM d))
SELECT event_type, R(t) AS t, value FROM l WHERE alive AND NOT coalesce(later >= value, false)""")
def peaks_with_exclusion(t):
    """The zone grows with the page: one row at 5,000 rows, 240 at 1,200,000."""
    return signal.exclude_near_peaks(t.event_pages, "t", "value", 0.0004)


@query(f"""WITH {TIMED}, x AS (SELECT event_type, t / 1e5 AS x, value AS y FROM t), f AS (SELECT event_type, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x GROUP BY 1)
SELECT event_type, R(a) AS "Intercept", R(b) AS "Slope", R(sqrt(avg(pow(y - a - b * x, 2)))) AS "RmsResidual", 2 AS "Terms" FROM f JOIN x USING (event_type) GROUP BY event_type, a, b""")
def fit_line(t):
    p = paged(t.timed.withColumn("x", F.col("t") / 1e5), "event_type", ("ts", "event_id"))
    return fits.polynomial(p, "x", ["value"], [0, 1]).select("event_type", "Intercept", "Slope", "RmsResidual", "Terms")


@query()
def fit_polynomial_chebyshev(t):
    return fits.polynomial_values(_wave(t), "x", "y", range(8), chebyshev=True)


#: Parabolas of y and z over x by Cramer's rule, from sums of powers.
_PARABOLA = """r AS (SELECT c_mktsegment AS g, c_nationkey / 10.0::DOUBLE AS x, c_acctbal / 1000 AS y, (c_custkey % 7)::DOUBLE AS z FROM customer), l AS (SELECT g, x, 'y' AS d, y AS v FROM r UNION ALL SELECT g, x, 'z', z FROM r),
s AS (SELECT g, d, count(*)::DOUBLE AS a, sum(x) AS b, sum(x * x) AS c, sum(x * x * x) AS e, sum(x * x * x * x) AS f, sum(v) AS u, sum(v * x) AS v, sum(v * x * x) AS w FROM l GROUP BY 1, 2),
q AS (SELECT *, a * (c * f - e * e) - b * (b * f - c * e) + c * (b * e - c * c) AS det FROM s),
fit AS (SELECT g, d, (u * (c * f - e * e) - b * (v * f - e * w) + c * (v * e - c * w)) / det AS c0, (a * (v * f - e * w) - u * (b * f - c * e) + c * (b * w - c * v)) / det AS c1, (a * (c * w - e * v) - b * (b * w - c * v) + u * (b * e - c * c)) / det AS c2 FROM q)"""


def _parabola(t):
    rows = t.customer.select("c_mktsegment", "c_custkey", (F.col("c_nationkey") / 10).alias("x"), (F.col("c_acctbal") / 1000).alias("y"), (F.col("c_custkey") % 7).cast("double").alias("z"))
    return paged(rows, "c_mktsegment", "c_custkey")


@query(f'WITH {_PARABOLA} SELECT g AS c_mktsegment, d AS "Dependent", R(c0) AS c0, R(c1) AS c1, R(c2) AS c2 FROM fit')
def fit_several(t):
    got = fits.polynomial(_parabola(t), "x", ["y", "z"], [0, 1, 2])
    return got.select("c_mktsegment", "Dependent", *[F.get("Coefficients", F.lit(k)).alias(f"c{k}") for k in range(3)])


@query(f"""WITH {_PARABOLA} SELECT r.g AS c_mktsegment, R(x) AS x, R(y) AS y, R(c0 + c1 * x + c2 * x * x) AS "yFit", R(y - c0 - c1 * x - c2 * x * x) AS "yResidual" FROM r JOIN fit ON r.g = fit.g AND d = 'y'""")
def fit_chebyshev_values(t):
    return fits.polynomial_values(_parabola(t), "x", "y", range(3), chebyshev=True).select("c_mktsegment", "x", "y", "yFit", "yResidual")


@query("SELECT p::BIGINT AS page, 1.0::DOUBLE AS \"expfitConstant\", 2.0::DOUBLE AS \"expfitFactor\", -1.5::DOUBLE AS \"expfitRate\" FROM range(3) r(p)")
def fit_exponential(t):
    p = _wave(t)
    return _near(fits.exponential(p.with_rows(p.rows.withColumn("y", 1 + 2 * F.exp(-1.5 * F.col("x")))), "x", "y"))


@query("SELECT p::BIGINT AS page, 1.0::DOUBLE AS \"gfitBaseline\", 5.0::DOUBLE AS \"gfitHeight\", 2.0::DOUBLE AS \"gfitMean\", 0.4::DOUBLE AS \"gfitSigma\" FROM range(3) r(p)")
def fit_gaussian(t):
    p = _wave(t)
    return _near(fits.gaussian(p.with_rows(p.rows.withColumn("y", 1 + 5 * F.exp(-F.pow((F.col("x") - 2) / 0.4, F.lit(2)) / 2))), "x", "y"))


@query("SELECT p::BIGINT AS page, 1.0::DOUBLE AS \"lfitBaseline\", 5.0::DOUBLE AS \"lfitHeight\", 2.0::DOUBLE AS \"lfitCenter\", 0.3::DOUBLE AS \"lfitGamma\" FROM range(3) r(p)")
def fit_lorentzian(t):
    p = _wave(t)
    return _near(fits.lorentzian(p.with_rows(p.rows.withColumn("y", 1 + 5 / (1 + F.pow((F.col("x") - 2) / 0.3, F.lit(2))))), "x", "y"))


@query()
def fit_sine(t):
    return fits.sine(_wave(t), "x", "y")


@query("SELECT p::BIGINT AS page, 2.0::DOUBLE AS a, -1.0::DOUBLE AS b FROM range(3) r(p)")
def fit_generic(t):
    p = _wave(t)
    return _near(fits.generic(p.with_rows(p.rows.withColumn("y", 2 * F.col("x") + F.exp(-F.col("x")))), "x", "y", "a * x + exp(b * x)", {"a": 1.0, "b": -0.5}))


@query()
def fit_spline(t):
    return fits.spline(_wave(t), "x", "y", 40)


@query("SELECT 'i0_j0' AS term, R(2.0) AS c UNION ALL SELECT 'i1_j0', 0.5 UNION ALL SELECT 'i0_j1', -1.5 UNION ALL SELECT 'i1_j1', 0.25 UNION ALL SELECT 'i2_j0', 0.0 UNION ALL SELECT 'i0_j2', 0.0")
def fit_surface(t):
    df = t.lineitem.select(F.col("l_linenumber").cast("double").alias("x"), (F.col("l_quantity") / 10).alias("y")).distinct()
    df = df.withColumn("z", 2 + 0.5 * F.col("x") - 1.5 * F.col("y") + 0.25 * F.col("x") * F.col("y"))
    got = fits.surface(df, "x", "y", "z", 2)
    return t.spark.createDataFrame([(f"i{i}_j{j}", round(c, 6) + 0.0) for (i, j), c in got.items()], "term string, c double")


@query("""WITH a AS (SELECT s_suppkey AS i, 'x' AS j, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'y', s_nationkey FROM supplier)
SELECT p.j AS i, q.j AS j, R(sum(p.v * q.v)) AS v FROM a p JOIN a q ON p.i = q.i GROUP BY 1, 2""")
def matrix_product(t):
    a = matrices.long_form(t.supplier.select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y")), "s_suppkey", ["x", "y"])
    return matrices.multiply(matrices.transpose(a), a)


@query("""SELECT s_suppkey AS i, 'x' AS j, R(s_acctbal - s_nationkey) AS v FROM supplier""")
def matrix_difference(t):
    a = t.supplier.select(F.col("s_suppkey").alias("i"), F.lit("x").alias("j"), F.col("s_acctbal").alias("v"))
    return matrices.add(a, t.supplier.select(F.col("s_suppkey").alias("i"), F.lit("x").alias("j"), F.col("s_nationkey").cast("double").alias("v")), -1)


def _square(t):
    rows = t.spark.range(9).select(F.floor(F.col("id") / 3).alias("page"), (F.col("id") % 3).alias("r"))
    return paged(rows.withColumn("a", 2 + F.col("r") * 1.0).withColumn("b", F.when(F.col("r") == 1, 5.0).otherwise(1.0 + F.col("page"))).withColumn("c", F.when(F.col("r") == 2, 7.0).otherwise(0.5)), "page", "r")


#: The matrix of a region is diagonal (2 + the nation's key) plus one of rank one, whose inverse has a closed form.
_INVERSE = """n AS (SELECT n_regionkey AS g, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r, 2.0::DOUBLE + n_nationkey AS d FROM nation), w AS (SELECT g, 1 + sum((r + 1) * (r + 1) / 10.0 / d) AS w FROM n GROUP BY 1),
m AS (SELECT a.g, a.r AS i, b.r AS j, CASE WHEN a.r = b.r THEN 1 / a.d ELSE 0 END - (a.r + 1) / a.d * (b.r + 1) / 10.0 / b.d / w AS v FROM n a JOIN n b ON a.g = b.g JOIN w ON w.g = a.g)"""


@query(f'WITH {_INVERSE} SELECT g AS n_regionkey, i AS "Row", ' + ", ".join(f"R(max(v) FILTER (WHERE j = {j})) AS c{j}" for j in range(5)) + " FROM m GROUP BY 1, 2")
def matrix_inverse(t):
    p = paged(t.nation, "n_regionkey", "n_nationkey").numbered("r")
    cell = lambda j: (F.when(F.col("r") == j, 2.0 + F.col("n_nationkey")).otherwise(0.0) + (F.col("r") + 1) * ((j + 1) / 10)).alias(f"c{j}")
    return matrices.invert(p.with_rows(p.rows.select("n_regionkey", "n_nationkey", *[cell(j) for j in range(5)])), [f"c{j}" for j in range(5)])


@query("WITH m AS (SELECT p, 1.0 + p AS q FROM range(3) r(p)) SELECT p AS page, R(2 * (5 * 7 - 0.5 * q) - q * (3 * 7 - 0.5 * 4) + 0.5 * (3 * q - 5 * 4)) AS \"Determinant\" FROM m")
def matrix_determinant(t):
    return matrices.determinant(_square(t), ["a", "b", "c"])


@query()
def matrix_pseudo_inverse(t):
    return matrices.pseudo_inverse(_vectors(t), _ALL, 1e-6)


#: Two columns of a segment's customers, with the sums of their products.
_PAIR = """p AS (SELECT c_mktsegment AS g, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS r, c_acctbal / 1000 AS a, c_nationkey + 1.0::DOUBLE AS b FROM customer), s AS (SELECT g, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM p GROUP BY 1)"""


def _pair(t):
    rows = t.customer.select("c_mktsegment", "c_custkey", (F.col("c_acctbal") / 1000).alias("a"), (F.col("c_nationkey") + 1.0).alias("b"))
    return paged(rows, "c_mktsegment", "c_custkey")


@query(f"""WITH {_PAIR} SELECT g AS c_mktsegment, 'a' AS "OldColumnName", r::INT AS "Row", R((bb * a - ab * b) / (aa * bb - ab * ab)) AS v FROM p JOIN s USING (g) UNION ALL SELECT g, 'b', r::INT, R((aa * b - ab * a) / (aa * bb - ab * ab)) FROM p JOIN s USING (g)""")
def matrix_pseudo_inverse_pair(t):
    return matrices.pseudo_inverse(_pair(t), ["a", "b"]).select("c_mktsegment", "OldColumnName", F.posexplode("Inverse").alias("Row", "v"))


@query(f"""WITH {_PAIR} SELECT g AS c_mktsegment, 0 AS "Index", R(sqrt((aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + ab * ab))) AS "SingularValue" FROM s UNION ALL SELECT g, 1, R(sqrt((aa + bb) / 2 - sqrt(pow((aa - bb) / 2, 2) + ab * ab))) FROM s""")
def matrix_singular_values_pair(t):
    return matrices.singular_values(_pair(t), ["a", "b"])


@query(f"""WITH {_PAIR} SELECT g AS c_mktsegment, 'a' AS "OldColumnName", r::INT AS "Row", R(a / (aa + bb)) AS "Real", R(-b / (aa + bb)) AS "Imag" FROM p JOIN s USING (g)""")
def matrix_complex_pseudo_inverse_column(t):
    cells = F.posexplode(F.arrays_zip("Real", "Imag")).alias("Row", "v")
    return matrices.complex_pseudo_inverse(_pair(t), ["a"], ["b"]).select("c_mktsegment", "OldColumnName", cells).select("c_mktsegment", "OldColumnName", "Row", "v.Real", "v.Imag")


@query()
def matrix_complex_pseudo_inverse(t):
    return matrices.complex_pseudo_inverse(_square(t), ["a", "b"], ["b", "c"])


@query()
def matrix_singular_values(t):
    return matrices.singular_values(_vectors(t), _ALL)


@query()
def principal_components(t):
    values, vectors = matrices.principal_components(t.embeddings, "embedding", 64, 3)
    return t.spark.createDataFrame([(i, float(v), d.tolist()) for i, (v, d) in enumerate(zip(values, vectors, strict=True))], "n int, variance double, direction array<double>")


@query()
def independent_components(t):
    p = _wave(t)
    rows = p.rows.withColumn("s", F.signum(F.sin(7 * F.col("x")))).withColumn("m1", F.col("y") + F.col("s")).withColumn("m2", F.col("y") - 0.5 * F.col("s"))
    return matrices.independent_components(p.with_rows(rows), ["m1", "m2"], 2)


@query("""SELECT c_mktsegment, row_number() OVER w - 1 AS "Row", R(lead(c_acctbal) OVER w - c_acctbal) AS "dc_acctbal" FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey) QUALIFY lead(c_acctbal) OVER w IS NOT NULL""")
def response_derivative(t):
    return matrices.response_derivative(t.customer_pages, ["c_acctbal"])


_PIXELS = "p AS (SELECT e.label, e.r, e.i, e.v FROM (SELECT label, r, unnest(range(64)) AS i, unnest(embedding[1:64])::DOUBLE AS v FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings)) e)"


def _pixels(t):
    return images.to_single_column(_vectors(t), _ALL)


@query(f'WITH {_PIXELS} SELECT label, r AS "Row", i::INT AS "Column", R(v) AS "Image" FROM p')
def image_to_pixels(t):
    return _pixels(t)


@query(f'WITH {_PIXELS} SELECT label, r AS "Row", ' + ", ".join(f"R(max(v) FILTER (WHERE i = {i})) AS line{i}" for i in range(64)) + " FROM p GROUP BY 1, 2")
def image_to_lines(t):
    return images.to_columns(_pixels(t), ["label", "Row"], "Column", "Image", [f"line{i}" for i in range(64)])


@query(f'WITH {_PIXELS} SELECT label, i::INT AS "Column", R(sum(v)) AS "Profile" FROM p GROUP BY 1, 2')
def image_profile(t):
    return images.profile(_pixels(t), ["label"], "Column", "Image")


@query(f"""WITH {_PIXELS}, q AS (SELECT *, greatest(v - 0.05, 0) AS w FROM p) SELECT label, R(sum(w)) AS "IntegratedSpotIntensity", R(max(w)) AS "PeakSpotIntensity", R(sum(i * w) / sum(w)) AS "xSpotCentroid", R(sum(r * w) / sum(w)) AS "ySpotCentroid",
R(sqrt(sum(i * i * w) / sum(w) - pow(sum(i * w) / sum(w), 2))) AS "xSpotSigma", R(sqrt(sum(r * r * w) / sum(w) - pow(sum(r * w) / sum(w), 2))) AS "ySpotSigma", count(*) FILTER (WHERE v >= 0.3) AS "SaturationCount" FROM q GROUP BY 1""")
def image_spot(t):
    return images.spot(_pixels(t), ["label"], "Column", "Row", "Image", 0.05, 0.3)


@query("""WITH p AS (SELECT c_mktsegment AS g, c_nationkey AS k, c_nationkey * 0.5 + sin(c_custkey::DOUBLE) * 0.0001 AS x FROM customer), e AS (SELECT g, min(k) AS lo, max(k) AS hi, count(DISTINCT k) AS n FROM p GROUP BY 1),
c AS (SELECT e.g, lo, hi, n, avg(x) FILTER (WHERE k = lo) AS first, avg(x) FILTER (WHERE k = hi) AS last FROM p JOIN e USING (g) GROUP BY ALL), d AS (SELECT *, (last - first) / (n - 1) AS d FROM c)
SELECT g AS c_mktsegment, R(floor((x - first) / d + 0.5) * d + first) AS x, R(d) AS "xInterval", n::INT AS "xDimension" FROM p JOIN d USING (g)""")
def snap_to_grid(t):
    rows = t.customer.select("c_mktsegment", "c_custkey", (F.col("c_nationkey") * 0.5 + F.sin(F.col("c_custkey").cast("double")) * 0.0001).alias("x"))
    return images.snap_to_grid(paged(rows, "c_mktsegment", "c_custkey"), "x", guess=0.5)


@query("SELECT true AS many, 0.0::DOUBLE AS worst")
def interpolate_scattered(t):
    p = paged(t.supplier.select(F.lit(1).alias("page"), "s_suppkey", (F.col("s_nationkey") + F.col("s_suppkey") / 1000).alias("x"), (F.col("s_acctbal") / 1000).alias("y")).withColumn("z", 2 * F.col("x") - F.col("y")), "page", "s_suppkey")
    out = images.interpolate_scattered(p, "x", "y", "z", (11, 11))  # a plane comes back as it is
    return out.agg((F.count(F.lit(1)) > 50).alias("many"), F.round(F.max(F.abs(F.col("z") - 2 * F.col("x") + F.col("y"))), 6).alias("worst"))


@query("""WITH s AS (SELECT c_mktsegment, c_custkey, c_acctbal AS a, c_nationkey::DOUBLE AS b, least(floor((c_custkey - min(c_custkey) OVER w)::DOUBLE / (max(c_custkey) OVER w - min(c_custkey) OVER w) * 8), 7)::INT AS k FROM customer WINDOW w AS (PARTITION BY c_mktsegment))
SELECT c_mktsegment, k AS "Slice", count(*) AS "Particles", R(avg(a)) AS "c_acctbalMean", R(stddev_pop(a)) AS "c_acctbalStDev", R(avg(b)) AS "c_nationkeyMean", R(stddev_pop(b)) AS "c_nationkeyStDev", R(sqrt(greatest(var_pop(a) * var_pop(b) - pow(covar_pop(a, b), 2), 0))) AS "Emittance" FROM s GROUP BY 1, 2""")
def slice_moments(t):
    return images.slice_moments(t.customer_pages, "c_custkey", ["c_acctbal", "c_nationkey"], 8)
