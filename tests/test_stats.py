import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.config import Weights
from caselens.functions import bayes, stats
from caselens.operators import trend

CELLS = [(20, 80, 10, 890), (5, 0, 10, 100), (100, 1000, 200, 1000000), (1, 50, 3, 9000), (0, 40, 7, 8000)]


def by_hand(a, b, c, d):
    n = a + b + c + d
    k = 0.5 if min(a, b, c, d) == 0 else 0
    x, y, z, w = a + k, b + k, c + k, d + k
    ror = x * w / (y * z)
    width = stats.Z95 * math.sqrt(1 / x + 1 / y + 1 / z + 1 / w)
    e = (a + b) * (a + c) / n
    chi = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    return ror, ror * math.exp(-width), ror * math.exp(width), (x / (x + y)) / (z / (z + w)), chi, e, a / (a + 0.5) * math.log(a / e) if a else 0.0


def test_statistics_by_hand(spark):
    t = spark.createDataFrame(CELLS, "a long, b long, c long, d long")
    c = tuple(F.col(x) for x in "abcd")
    low, high = stats.ror_interval(*c)
    got = t.select("a", "b", "c", "d", stats.ror(*c), low, high, stats.prr(*c), stats.chi_square_yates(*c), stats.expected(*c), stats.shrunken(*c)).collect()
    for r in got:
        assert list(r[4:]) == pytest.approx(by_hand(*r[:4]), rel=1e-9)
    assert got[0][4] == pytest.approx(22.25)


def test_cells_never_fall_below_zero(spark):
    t = spark.createDataFrame([(10, 100, 200, 10000), (10, 5, 5, 10)], "a long, x long, y long, n long")
    got = t.select(*stats.cells(F.col("a"), F.col("x"), F.col("y"), F.col("n")).values()).collect()
    assert [tuple(r) for r in got] == [(10, 90, 190, 9710), (10, 0, 0, 0)]


def test_empty_margins_and_flags(spark):
    t = spark.createDataFrame([(0, 0, 0, 0), (20, 80, 10, 8000), (2, 80, 10, 8000)], "a long, b long, c long, d long")
    c = tuple(F.col(x) for x in "abcd")
    low, _ = stats.ror_interval(*c)
    got = t.select(stats.chi_square_yates(*c), stats.expected(*c), stats.observed_to_expected(*c), stats.is_signal(F.col("a"), low, stats.prr(*c), stats.chi_square_yates(*c))).collect()
    assert tuple(got[0]) == (0.0, 0.0, None, False)
    assert [r[3] for r in got] == [False, True, False]


def test_poisson_tail_and_ewma(spark):
    rows = [(0, 3.0), (1, 3.0), (5, 3.0), (3, 0.0), (0, 0.0), (900, 900.0), (2000, 900.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "k long, m double").select(stats.poisson_tail(F.col("k"), F.col("m"))).collect()]
    assert got[:5] == pytest.approx([1, 1 - math.exp(-3), 1 - math.exp(-3) * sum(3**i / math.factorial(i) for i in range(5)), 0, 1])
    assert 0.45 < got[5] < 0.55 and got[6] < 1e-9
    e = spark.createDataFrame([([10, 12, 11, 9],), ([4],)], "x array<long>").select(stats.ewma(F.col("x"))).collect()
    assert [r[0] for r in e] == [0.5 * 9 + 0.5 * (0.5 * 11 + 0.5 * (0.5 * 12 + 0.5 * 10)), 4.0]


def test_trend_of_a_spike_and_a_flat_series(spark):
    rows = [(d, "E", f"2020Q{i}" if i < 5 else "2021Q1", v) for d, s in (("SPIKE", [10, 12, 11, 9, 40]), ("FLAT", [10, 10, 10, 10, 10])) for i, v in enumerate(s, 1)]
    t = spark.createDataFrame(rows, "drug string, event string, quarter string, report_count long")
    got = {r["drug"]: r for r in trend.anomalies(trend.baseline(t)).filter("quarter = '2021Q1'").collect()}
    assert got["SPIKE"]["percent_change"] > 2.5 and got["SPIKE"]["anomaly_score"] > 3 and 0 <= got["SPIKE"]["poisson_anomaly_score"] <= 1
    assert got["FLAT"]["percent_change"] == 0 and got["FLAT"]["anomaly_score"] is None


def test_priority_levels_and_weights(spark):
    t = spark.createDataFrame([(0.8,), (0.6,), (0.1,)], "x double")
    assert [r[0] for r in t.select(trend.priority_level(F.col("x"))).collect()] == ["High", "Moderate", "Low"]
    with pytest.raises(ValueError):
        Weights(disproportionality=0.5)
    nan = spark.range(1).select(trend.priority(F.lit(float("nan")), F.lit(None), F.lit(2.0), F.lit(1.0), F.lit(-1.0))).first()[0]
    assert nan == pytest.approx(0.20 + 0.15)


def test_gamma_functions():
    x = np.array([0.01, 0.5, 1, 3.3, 20, 1000])
    assert bayes.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)
    assert bayes.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329)
    assert bayes.digamma(x + 1) == pytest.approx(bayes.digamma(x) + 1 / x)
    assert bayes.gamma_cdf(1.0, np.array([0.2, 1, 9])) == pytest.approx(1 - np.exp([-0.2, -1, -9]))


def test_empirical_bayes_on_a_planted_mixture():
    rng = np.random.default_rng(0)
    e = rng.uniform(1, 30, 3000)
    rate = np.where(rng.random(3000) < 0.2, rng.gamma(3, 1, 3000), rng.gamma(2, 0.5, 3000))
    rate[:5], e[:5] = 8, 20
    n = rng.poisson(rate * e)
    theta = bayes.fit(n, e)
    assert theta[0] / theta[1] <= theta[2] / theta[3]
    ebgm, low, high = bayes.scores(n, e, theta)
    assert (low >= 0).all() and (low <= high).all() and (low <= ebgm + 1e-9).all()
    assert (low[:5] > 2).all() and (ebgm[:5] > 3).all()
    few, many = bayes.scores(np.array([2, 80]), np.array([1.0, 40.0]), theta)[0]
    assert abs(few - 2) > abs(many - 2)
    with pytest.raises(ValueError):
        bayes.fit(np.array([]), np.array([]))
