"""Gamma-Poisson shrinkage of observed against expected counts.

The mixture's five parameters are fitted on the driver from a bounded sample; scores are an
Arrow function over batches, for want of gamma functions among the built-in ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the search starts, and its box in logarithms and log-odds. Fixed values.
START = (0.2, 0.1, 2.0, 4.0, 0.3333)
LOW = np.array([np.log(1e-3)] * 4 + [-6.0])
HIGH = np.array([np.log(1e3)] * 4 + [6.0])
SAMPLE = 200_000
#: Evaluations of the likelihood in a whole fit, at most; one takes a quarter of a second on
#: the largest sample, so a fit ends within about two minutes whatever the counts.
EVALUATIONS = 480
#: Steps after which starts are compared, and the gain of a step, as a share of the value,
#: below which a search ends after three such steps.
FIRST_STEPS = 25
LEAST_GAIN = 1e-8


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series ten steps further on, and back by the recurrence."""
    x = np.asarray(x, dtype=float)
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    steps = sum(np.log(x + i) for i in range(10))
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - steps


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    z = x + 10
    series = np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    return series - sum(1 / (x + i) for i in range(10))


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: a power series below a + 1, a continued
    fraction above it."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.zeros(a.shape)
    low = (x > 0) & (x < a + 1)
    with np.errstate(all="ignore"):
        head = np.exp(a * np.log(np.where(x > 0, x, 1)) - x - lgamma(a))
        if low.any():
            aa, xx = a[low], x[low]
            term = total = 1 / aa
            for k in range(1, 20_000):
                term = term * xx / (aa + k)
                total = total + term
                if (term <= 1e-16 * total).all():
                    break
            out[low] = head[low] * total
        up = x >= a + 1
        if up.any():
            aa, xx = a[up], x[up]
            b = xx + 1 - aa
            c, d = np.full(aa.shape, 1e300), 1 / b
            h = d
            for k in range(1, 20_000):
                an = -k * (k - aa)
                b = b + 2
                d = an * d + b
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = b + an / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                step = c * d
                h = h * step
                if (np.abs(step - 1) < 1e-15).all():
                    break
            out[up] = 1 - head[up] * h
    return np.clip(out, 0, 1)


def nb_log_pmf(n: np.ndarray, e: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """Log probability of n when its Poisson mean is e times a gamma variable."""
    return lgamma(alpha + n) - lgamma(np.array(alpha)) - lgamma(n + 1.0) + alpha * np.log(beta / (beta + e)) + n * np.log(e / (beta + e))


def negative_log_likelihood(t: np.ndarray, n: np.ndarray, e: np.ndarray) -> tuple[float, np.ndarray]:
    """Of (ln a1, ln b1, ln a2, ln b2, logit p), with its gradient."""
    a1, b1, a2, b2 = np.exp(t[:4])
    p = 1 / (1 + np.exp(-t[4]))
    f1, f2 = np.log(p) + nb_log_pmf(n, e, a1, b1), np.log1p(-p) + nb_log_pmf(n, e, a2, b2)
    whole = np.logaddexp(f1, f2)
    w = np.exp(f1 - whole)
    slopes = []
    for share, a, b in ((w, a1, b1), (1 - w, a2, b2)):
        slopes.append((share * (digamma(a + n) - digamma(np.array(a)) + np.log(b / (b + e)))).sum() * a)
        slopes.append((share * (a / b - (a + n) / (b + e))).sum() * b)
    return -float(whole.sum()), -np.array([*slopes, (w - p).sum()])


class Search:
    """Damped quasi-Newton steps inside the box from one start. It ends when steps gain next
    to nothing, as on the flat ridge of counts that hold no clear mixture."""

    def __init__(self, start: tuple[float, ...], n: np.ndarray, e: np.ndarray):
        self.n, self.e = n, e
        self.t = np.array([*np.log(start[:4]), np.log(start[4] / (1 - start[4]))])
        self.value, self.slope = negative_log_likelihood(self.t, n, e)
        self.inverse, self.evaluations, self.idle, self.done = self.plain(), 1, 0, False

    def plain(self) -> np.ndarray:
        return np.eye(5) / max(np.abs(self.slope).max(), 1.0)

    def step(self) -> None:
        free = ~(((self.t <= LOW) & (self.slope > 0)) | ((self.t >= HIGH) & (self.slope < 0)))
        way = -(self.inverse * np.outer(free, free)) @ self.slope
        if way @ self.slope >= 0:
            self.inverse = self.plain()
            way = -self.slope * free / max(np.abs(self.slope).max(), 1.0)
        size = min(1.0, 2 / max(np.abs(way).max(), 1e-12))
        for _ in range(20):
            t = np.clip(self.t + size * way, LOW, HIGH)
            value, slope = negative_log_likelihood(t, self.n, self.e)
            self.evaluations += 1
            if np.isfinite(value) and value <= self.value + 1e-4 * (self.slope @ (t - self.t)):
                break
            size /= 2
        else:
            self.done = True
            return
        s, y = t - self.t, slope - self.slope
        if s @ y > 1e-12:
            left = np.eye(5) - np.outer(s, y) / (s @ y)
            self.inverse = left @ self.inverse @ left.T + np.outer(s, s) / (s @ y)
        self.idle = self.idle + 1 if self.value - value <= LEAST_GAIN * max(abs(self.value), 1.0) else 0
        self.done = self.idle >= 3
        self.t, self.value, self.slope = t, value, slope

    def run(self, steps: int, evaluations: int) -> None:
        for _ in range(steps):
            if self.done or self.evaluations >= evaluations:
                break
            self.step()


def fit(n: np.ndarray, e: np.ndarray, evaluations: int = EVALUATIONS) -> tuple[float, float, float, float, float]:
    """(a1, b1, a2, b2, p) that maximise the likelihood, components by rising mean. Searches
    from several starts go a few steps each; the best of them goes on to its end."""
    n, e = np.asarray(n, dtype=float), np.maximum(np.asarray(e, dtype=float), 1e-9)
    if n.shape != e.shape or not len(n):
        raise ValueError("observed and expected counts must be alike and not empty")
    starts = (START, (1.0, 1.0, 3.0, 2.0, 0.5), (0.5, 0.5, 5.0, 5.0, 0.1))
    searches = [Search(s, n, e) for s in starts]
    for x in searches:
        x.run(FIRST_STEPS, evaluations // (2 * len(starts)))
    best = min(searches, key=lambda x: x.value)
    spent = sum(x.evaluations for x in searches if x is not best)
    best.run(evaluations, evaluations - spent)
    a1, b1, a2, b2 = np.exp(best.t[:4])
    p = 1 / (1 + np.exp(-best.t[4]))
    return (a1, b1, a2, b2, p) if a1 / b1 <= a2 / b2 else (a2, b2, a1, b1, 1 - p)


def posterior_weight(n: np.ndarray, e: np.ndarray, theta: tuple[float, ...]) -> np.ndarray:
    """The first component's share in the posterior mixture."""
    a1, b1, a2, b2, p = theta
    f1, f2 = np.log(p) + nb_log_pmf(n, e, a1, b1), np.log1p(-p) + nb_log_pmf(n, e, a2, b2)
    return np.exp(f1 - np.logaddexp(f1, f2))


def scores(n: np.ndarray, e: np.ndarray, theta: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ebgm, eb05, eb95): geometric mean and quantiles of the posterior mixture."""
    a1, b1, a2, b2, p = theta
    n, e = np.asarray(n, dtype=float), np.maximum(np.asarray(e, dtype=float), 1e-9)
    w = posterior_weight(n, e, theta)
    ebgm = np.exp(w * (digamma(a1 + n) - np.log(b1 + e)) + (1 - w) * (digamma(a2 + n) - np.log(b2 + e)))

    def below(x: np.ndarray) -> np.ndarray:
        return w * gamma_cdf(a1 + n, x * (b1 + e)) + (1 - w) * gamma_cdf(a2 + n, x * (b2 + e))

    def quantile(q: float) -> np.ndarray:
        low, high = np.zeros(len(n)), 10 * np.maximum((a1 + n) / (b1 + e), (a2 + n) / (b2 + e)) + 10
        for _ in range(40):
            if not (short := below(high) < q).any():
                break
            high = np.where(short, high * 2, high)
        for _ in range(60):
            mid = (low + high) / 2
            up = below(mid) < q
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        return (low + high) / 2

    return ebgm, quantile(0.05), quantile(0.95)


def score_columns(n: Column, e: Column, theta: tuple[float, ...]) -> Column:
    """A struct of ebgm, eb05, eb95 and the first component's posterior weight."""

    @F.pandas_udf("struct<ebgm:double,eb05:double,eb95:double,weight:double>")
    def run(observed: pd.Series, expected: pd.Series) -> pd.DataFrame:
        n, e = observed.to_numpy(dtype=float), np.maximum(expected.to_numpy(dtype=float), 1e-9)
        return pd.DataFrame(dict(zip(("ebgm", "eb05", "eb95", "weight"), (*scores(n, e, theta), posterior_weight(n, e, theta)))))

    return run(n.cast("double"), e)


def log_pmf_column(n: Column, e: Column, alpha: float, beta: float) -> Column:
    @F.pandas_udf("double")
    def run(observed: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series(nb_log_pmf(observed.to_numpy(dtype=float), expected.to_numpy(dtype=float), alpha, beta))

    return run(n.cast("double"), e)


def fit_sample(pairs: DataFrame, keys: list[str], observed: str, expected: str, most: int = SAMPLE) -> tuple[float, ...]:
    """The parameters for at most `most` pairs by the order of a hash of their keys."""
    few = pairs.select(observed, expected, F.xxhash64(*keys).alias("o")).orderBy("o").limit(most).toPandas()
    return fit(few[observed].to_numpy(), few[expected].to_numpy())
