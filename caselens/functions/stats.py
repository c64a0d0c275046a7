"""Disproportionality statistics of 2x2 cells as column expressions.

Everything stays in generated code; undefined values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselens.config import Thresholds

#: Two-sided 95 % normal quantile. Fixed value.
Z95 = 1.959963984540054


def cells(a: Column, item_total: Column, event_total: Column, n: Column) -> dict[str, Column]:
    """a, b, c, d from totals; no cell below 0."""
    b = F.greatest(item_total - a, F.lit(0))
    c = F.greatest(event_total - a, F.lit(0))
    return {"a": a, "b": b, "c": c, "d": F.greatest(n - a - b - c, F.lit(0))}


def needs_correction(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.least(a, b, c, d) == 0


def corrected(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, ...]:
    """A half is added to every cell where any is 0."""
    extra = F.when(needs_correction(a, b, c, d), 0.5).otherwise(0.0)
    return tuple(x.cast("double") + extra for x in (a, b, c, d))


def ror(a: Column, b: Column, c: Column, d: Column) -> Column:
    a, b, c, d = corrected(a, b, c, d)
    return (a * d) / (b * c)


def ror_interval(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    x = ror(a, b, c, d)
    a, b, c, d = corrected(a, b, c, d)
    width = Z95 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.exp(F.log(x) - width), F.exp(F.log(x) + width)


def prr(a: Column, b: Column, c: Column, d: Column) -> Column:
    a, b, c, d = corrected(a, b, c, d)
    return (a / (a + b)) / (c / (c + d))


def chi_square_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """On the raw cells; 0 where a margin is 0. The bracket is not cut off at 0."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins == 0, 0.0).otherwise(n * F.pow(F.abs(a * d - b * c) - n / 2, 2.0) / F.when(margins != 0, margins))


def expected(a: Column, b: Column, c: Column, d: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    return F.coalesce(F.try_divide((a + b) * (a + c), n), F.lit(0.0))


def observed_to_expected(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.try_divide(a.cast("double"), expected(a, b, c, d))


def shrunken(a: Column, b: Column, c: Column, d: Column, strength: float = 0.5) -> Column:
    """a / (a + strength) ln(a / expected); 0 where either is 0."""
    e, x = expected(a, b, c, d), a.cast("double")
    return F.when((e > 0) & (x > 0), x / (x + strength) * F.log(x / F.when(e > 0, e))).otherwise(0.0)


def is_signal(a: Column, ci_lower: Column, prr: Column, chi2: Column, t: Thresholds = Thresholds()) -> Column:
    return (a >= t.minimum_reports) & (ci_lower > t.ror_lower_ci) & (prr >= t.prr) & (chi2 >= t.chi_square)


def clip01(x: Column) -> Column:
    """Between 0 and 1; null and NaN become 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(0.0))))


def safe_ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x.cast("double"), y.cast("double"))


def poisson_tail(k: Column, rate: Column) -> Column:
    """P(X >= k) for a Poisson mean; 1 for k <= 0, else 0 for a mean of 0 or below.

    Terms are summed as logarithms, so that large means do not underflow: of k.. upwards
    where k is above the mean, else of k - 1 downwards. Both fall at least as fast as a
    normal density's tail, so their number follows the root of k.
    """
    mean = F.when(rate > 0, rate.cast("double"))
    above = k > mean
    start = F.when(above, k.cast("double")).otherwise(k.cast("double") - 1)
    enough = (40 + 9 * F.sqrt(F.greatest(k, F.lit(1)).cast("double"))).cast("int")
    steps = F.sequence(F.lit(1), F.when(above, enough).otherwise(F.least(enough, F.greatest(k.cast("int") - 1, F.lit(1)))))
    first = start * F.log(mean) - mean - lgamma(start + 1)
    up = F.aggregate(steps, F.struct(first.alias("term"), F.exp(first).alias("total")), lambda s, i: F.struct((s["term"] + F.log(mean) - F.log(start + i)).alias("term"), (s["total"] + F.exp(s["term"] + F.log(mean) - F.log(start + i))).alias("total")), lambda s: s["total"])
    # downwards: term of j - 1 from that of j
    down = F.aggregate(steps, F.struct(first.alias("term"), F.exp(first).alias("total")), lambda s, i: F.struct((s["term"] + F.log(start - i + 1) - F.log(mean)).alias("term"), (s["total"] + F.when(start - i >= 0, F.exp(s["term"] + F.log(start - i + 1) - F.log(mean))).otherwise(0.0)).alias("total")), lambda s: s["total"])
    tail = F.when(above, up).otherwise(1 - down)  # only one of them is worked out
    return F.when(k <= 0, 1.0).when(rate <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def lgamma(x: Column) -> Column:
    """Stirling's series ten steps further on, and back by the recurrence; x over 0."""
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    steps = sum((F.log(x + i) for i in range(1, 10)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - steps


def ewma(series: Column, alpha: float = 0.5) -> Column:
    """Exponentially weighted mean of an array, oldest first; its first element is the seed."""
    return F.aggregate(F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0))), F.get(series, F.lit(0)).cast("double"), lambda s, x: alpha * x + (1 - alpha) * s)
