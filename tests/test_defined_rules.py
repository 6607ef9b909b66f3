"""Rules by which rows are paired, clipped and offset, on rows small enough to work out by hand."""

import numpy as np
import pytest

from quire.frame import paged
from quire.operators import aggregates, ordered, signal


def frame(spark, **columns):
    rows = [(0, i, *map(float, r)) for i, r in enumerate(zip(*columns.values(), strict=True))]
    return paged(spark.createDataFrame(rows, "p int, i int, " + ", ".join(f"{c} double" for c in columns)), "p", "i")


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_shift_pairs_a_row_with_the_others_row_before_it(spark):
    ref = [3.0, 1, 4, 1, 5, 9, 2, 6, 5, 3]
    data = [*ref[3:], 0.0, 8, 7]  # data[i] = ref[i + 3]
    got = {r["ShiftAmount"]: r["dataShiftedCor"] for r in aggregates.shift_correlation(frame(spark, data=data, ref=ref), "data", "ref", [-3, 3]).collect()}
    assert got[-3] == pytest.approx(1.0)
    assert got[3] == pytest.approx(np.corrcoef(data[3:], ref[:-3])[0, 1])


def test_equal_values_share_the_mean_of_their_ranks(spark):
    a, b = [1, 1, 2, 3, 3, 3], [5, 1, 4, 4, 2, 6]
    mean_rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
    got = aggregates.correlations(frame(spark, a=a, b=b), ["a", "b"], rank=True).first()
    assert got["CorrelationCoefficient"] == pytest.approx(np.corrcoef(mean_rank(a), mean_rank(b))[0, 1])


@pytest.mark.parametrize(
    "given, kept, options",
    [
        ([2, 6, 1, 10, 1, 7, 2], [0, 0, 0, 10, 0, 0, 0], {"fraction": 0.5}),
        ([4, 6, 5, 10, 5, 4, 9], [0, 6, 5, 10, 5, 0, 0], {"fraction": 0.5}),
        ([4, 6, 5, 10, 3, 4, 10], [4, 6, 5, 10, 3, 4, 10], {"fraction": 0.5, "limit": 2.0}),
        ([1, 9], [1, 9], {"fraction": 0.5}),
        ([-3, 0, -1], [-3, 0, -1], {"fraction": 0.5}),
        ([-3, -2, -9], [-3, -2, -9], {"fraction": 0.5}),
    ],
)
def test_tails_are_clipped_outwards_from_the_first_maximum(spark, given, kept, options):
    out = ordered.clip_tails(frame(spark, y=given), "y", in_tail=True, **options).rows
    assert column(out, "y") == kept
    assert column(out, "InTail") == [int(a != b) for a, b in zip(given, kept, strict=True)]


def test_peaks_at_the_threshold_and_of_seven_points(spark):
    assert column(ordered.peaks(frame(spark, y=[0, 5, 0, 4, 0]), "y", 5.0).rows, "i") == [1]
    assert column(ordered.peaks(frame(spark, y=[0, 1, 2, 3, 3, 2, 1, 0]), "y", points=7).rows, "i") == []
    assert column(ordered.peaks(frame(spark, y=[0, 1, 2, 3, 2, 1, 0]), "y", points=7).rows, "i") == [3]


def test_offsets_of_both_states(spark):
    fixed = lambda y, **options: column(ordered.remove_offsets(frame(spark, y=y), "y", **options).rows, "y")
    assert fixed([1, 5, 1, 5, 2]) == pytest.approx([-1 / 3, 0, -1 / 3, 0, 2 / 3])
    assert fixed([1, 1, 5, 5, 1, 2, 5, 5], pattern=4) == [-0.25, -0.25, 0, 0, -0.25, 0.75, 0, 0]
    assert fixed([5, 1, 1, 5, 5, 1, 3, 5], pattern=4) == [0, -0.5, -0.5, 0, 0, -0.5, 1.5, 0]
    assert fixed([1, 5, 2, 9], head=0.5, commutation_only=True) == [3, 3, 4, 7]
    with pytest.raises(Exception, match="too few head rows"):
        fixed([1])


def test_correlation_and_deconvolution_end_in_zeros(spark):
    rng = np.random.default_rng(5)
    x, n = rng.normal(size=20), 20
    t = np.arange(n) * 0.5
    response = np.exp(-t)
    full = np.convolve(x, response)[:n] * 0.5
    got = signal.deconvolve(frame(spark, t=t, s=full, r=response), "s", "r", "d", noise=1e-12, t="t")
    power = np.abs(np.fft.rfft(response, 2 * n)) ** 2
    want = np.fft.irfft(np.fft.rfft(full, 2 * n) * np.conj(np.fft.rfft(response, 2 * n)) / power, 2 * n)[:n] / 0.5
    assert np.allclose(column(got, "d", "Row"), want)
    got = signal.correlate(frame(spark, t=t - 1, a=x, b=response), "a", "b", "c", t="t")
    want = [0.5 * sum(x[j] * response[i] for i in range(n) for j in range(n) if j == i - 2 + k) for k in range(n)]
    assert np.allclose(column(got, "c", "Row"), want)


def test_peeling_finds_the_layers_of_a_simulated_line(spark):
    """Each half step, interface k sends (1 + g) a - g b on and g a + (1 - g) b back of what comes from either side."""
    rng = np.random.default_rng(2)
    n = 60
    g = rng.uniform(-0.3, 0.3, n)
    a, b, seen = np.zeros(n), np.zeros(n), []
    for half in range(2 * n):
        a[0] = 1.0 if half % 2 == 0 else 0.0
        on, back = (1 + g) * a - g * b, g * a + (1 - g) * b
        if half % 2 == 0:
            seen.append(back[0])
        a, b = np.r_[0.0, on[:-1]], np.r_[back[1:], 0.0]
    got = column(signal.peel_impedance(frame(spark, v=seen), "v", 1.0), "PeeledImpedance", "Row")
    assert np.allclose(got, 50 * np.cumprod((1 + g) / (1 - g)), rtol=1e-6)
