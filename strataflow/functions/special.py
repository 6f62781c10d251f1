"""Distribution functions in numpy, from their published series and continued fractions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _vector(f):
    return np.vectorize(f, otypes=[float])


log_gamma = _vector(math.lgamma)
normal_cdf = _vector(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)))


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


gamma_p, beta_i = _vector(_gamma_p), _vector(_beta_i)


def student_two_sided(t, df):
    return beta_i(np.asarray(df) / 2, 0.5, df / (df + np.asarray(t) ** 2))


def chi_square_upper(x, df):
    return 1 - gamma_p(np.asarray(df) / 2, np.asarray(x) / 2)


def f_upper(f, d1, d2):
    return beta_i(np.asarray(d2) / 2, np.asarray(d1) / 2, d2 / (d2 + d1 * np.asarray(f)))


def normal_two_sided(z):
    return 2 * normal_cdf(-np.abs(np.asarray(z, float)))


def kolmogorov_upper(x):
    """Survival of the Kolmogorov distribution."""

    def one(v: float) -> float:
        if v <= 0:
            return 1.0
        if v < 1:
            return 1 - math.sqrt(2 * math.pi) / v * sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * v * v)) for k in range(1, 20))
        return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * v * v) for k in range(1, 100))))

    return _vector(one)(x)


def _solve(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def student_quantile(p, df):
    """The value that Student's t with `df` degrees of freedom stays below with probability p."""

    def one(q: float, d: float) -> float:
        if q == 0.5:
            return 0.0
        if q < 0.5:
            return -one(1 - q, d)
        # x = d / (d + t²) has the regularised beta function of its upper tail.
        x = _solve(lambda v: _beta_i(d / 2, 0.5, v) - 2 * (1 - q), 0.0, 1.0)
        return math.sqrt(d * (1 - x) / x) if x > 0 else math.inf

    return _vector(one)(p, df)


def normal_quantile(p):
    return _vector(lambda q: _solve(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)) - q, -40.0, 40.0))(p)


def digamma(x):
    """First derivative of the log gamma function: shifted up by its recurrence, then its asymptotic series."""

    def one(v: float) -> float:
        shift = 0.0
        while v < 10:
            shift -= 1 / v
            v += 1
        u = 1 / (v * v)
        return shift + math.log(v) - 1 / (2 * v) - u * (1 / 12 - u * (1 / 120 - u * (1 / 252 - u * (1 / 240 - u / 132))))

    return _vector(one)(x)


def trigamma(x):
    """Second derivative of the log gamma function."""

    def one(v: float) -> float:
        shift = 0.0
        while v < 12:
            shift += 1 / (v * v)
            v += 1
        u = 1 / (v * v)
        return shift + 1 / v + u / 2 + u / v * (1 / 6 - u * (1 / 30 - u * (1 / 42 - u * (1 / 30 - u * 5 / 66))))

    return _vector(one)(x)


def poisson_interval(n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact (Garwood) interval of a count."""
    a = (1 - level) / 2
    top = n + 20 * math.sqrt(n + 1) + 40
    low = 0.0 if n == 0 else _solve(lambda m: _gamma_p(n, m) - a, 0.0, top)
    return low, _solve(lambda m: _gamma_p(n + 1, m) - (1 - a), 0.0, top)


def binomial_interval(x: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact (Clopper-Pearson) interval of a share."""
    a = (1 - level) / 2
    low = 0.0 if x == 0 else _solve(lambda p: _beta_i(x, n - x + 1, p) - a, 0.0, 1.0)
    return low, 1.0 if x == n else _solve(lambda p: _beta_i(x + 1, n - x, p) - (1 - a), 0.0, 1.0)


def column(f):
    """A function of arrays as an Arrow UDF over double columns; null where an argument is null."""

    @F.pandas_udf(DoubleType())
    def run(*xs: pd.Series) -> pd.Series:
        values = [x.to_numpy(float, na_value=np.nan) for x in xs]
        known = ~np.isnan(np.vstack(values)).any(axis=0)
        out = np.full(len(known), np.nan)
        if known.any():
            out[known] = f(*[v[known] for v in values])
        return pd.Series(out).where(known, None)

    return lambda *cs: run(*[c.cast("double") if isinstance(c, Column) else F.lit(float(c)) for c in cs])
