"""Display and analysis scales of channels. Those with a closed form are columns; the others are Arrow UDFs.

Published definitions: logicle and hyperlog (T, W, M, A), inverse hyperbolic sine, biexponential table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LN10 = math.log(10.0)


def linear(low: float, high: float) -> Callable[[Column], Column]:
    span = (high - low) or 1.0
    return lambda c: (c - F.lit(low)) / F.lit(span)


def log(low: float, high: float) -> Callable[[Column], Column]:
    """Null for null; minus infinity at and below zero."""
    a, b = math.log10(low), math.log10(high)
    return lambda c: F.when(c > 0, (F.log10(c) - F.lit(a)) / F.lit(b - a)).when(c <= 0, F.lit(float("-inf")))


def _asinh(c: Column) -> Column:
    # F.asinh overflows for large negative values; the odd form is exact there too
    size = F.abs(c)
    return F.signum(c) * F.log(size + F.sqrt(size * size + 1.0))


def arcsinh(cofactor: float = 150.0, high: float = 262144.0, low: float | None = None) -> Callable[[Column], Column]:
    low = -cofactor * math.sinh(1.0) if low is None else low
    a, b = math.asinh(low / cofactor), math.asinh(high / cofactor)
    return lambda c: (_asinh(c / F.lit(cofactor)) - F.lit(a)) / F.lit(b - a)


def fasinh(top: float = 262144.0, decades: float = 4.5, negative: float = 0.0) -> Callable[[Column], Column]:
    scale = math.sinh(decades * LN10) / top
    return lambda c: (_asinh(c * F.lit(scale)) + F.lit(negative * LN10)) / F.lit((decades + negative) * LN10)


def _logicle_constants(T: float, W: float, M: float, A: float) -> tuple:
    w, x2 = W / (M + A), A / (M + A)
    x1 = x2 + w
    x0 = x2 + 2 * w
    b = (M + A) * LN10
    low, high = 0.0, b
    for _ in range(200):  # 2 (ln d - ln b) + w (b + d) = 0 by bisection
        d = (low + high) / 2
        if w == 0:
            d = b
            break
        if 2 * (math.log(d) - math.log(b)) + w * (b + d) > 0:
            high = d
        else:
            low = d
    ca = math.exp(x0 * (b + d))
    mf = math.exp(b * x1) - ca / math.exp(d * x1)
    a = T / (math.exp(b) - mf - ca / math.exp(d))
    return a, b, ca * a, d, mf * a, x1


def logicle_values(x: np.ndarray, T: float = 262144.0, W: float = 0.5, M: float = 4.5, A: float = 0.0) -> np.ndarray:
    """Solve x = a e^(b y) + f - c e^(-d y) for y by Newton steps inside a shrinking bracket; odd about x1."""
    a, b, c, d, f, x1 = _logicle_constants(T, W, M, A)
    forward = lambda y: a * np.exp(b * y) - f - c * np.exp(-d * y)
    size = np.abs(np.asarray(x, float))
    low, high = np.full(size.shape, x1), np.full(size.shape, x1 + 1.0)
    while np.any(grow := forward(high) < size):
        high[grow] += 1.0
    y = (low + high) / 2
    for _ in range(60):
        off = forward(y) - size
        high, low = np.where(off > 0, y, high), np.where(off > 0, low, y)
        step = y - off / (a * b * np.exp(b * y) + c * d * np.exp(-d * y))
        y = np.where((step > low) & (step < high), step, (low + high) / 2)
    return np.where(np.isnan(x), np.nan, np.where(np.asarray(x) >= 0, y, 2 * x1 - y))


def hyperlog_values(x: np.ndarray, T: float = 262144.0, W: float = 0.5, M: float = 4.5, A: float = 0.0) -> np.ndarray:
    """Solve x = a e^(b y) + c y - f for y by bisection; odd about x1."""
    b = (M + A) * LN10
    w, x2 = W / (M + A), A / (M + A)
    x1, x0 = x2 + w, x2 + 2 * w
    e0 = math.exp(b * x0)
    ca = e0 / w if w else e0
    fa = math.exp(b * x1) + ca * x1
    a = T / (math.exp(b) + ca - fa)
    c, f = ca * a, fa * a
    size = np.abs(np.asarray(x, float))
    low, high = np.full(size.shape, x1), np.full(size.shape, x1 + 2.0)
    for _ in range(80):
        y = (low + high) / 2
        over = a * np.exp(b * y) + c * y - f > size
        high, low = np.where(over, y, high), np.where(over, low, y)
    return np.where(np.isnan(x), np.nan, np.where(np.asarray(x) >= 0, y, 2 * x1 - y))


def biex_table(points: int = 4097, top: float = 262144.0, width: float = -10.0, decades: float = 4.5, negative: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Values and positions of a biexponential scale: the logicle curve of the matching width, sampled evenly."""
    W = math.log10(-min(width, -math.sqrt(10.0))) / 2
    a, b, c, d, f, x1 = _logicle_constants(top, W, decades, negative)
    y = np.linspace(0.0, 1.0, points)
    up = np.maximum(y, 2 * x1 - y)
    value = a * np.exp(b * up) - f - c * np.exp(-d * up)
    return np.where(y >= x1, value, -value), y


def _udf(values: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    @F.pandas_udf(DoubleType())
    def run(s: pd.Series) -> pd.Series:
        x = s.to_numpy(float, na_value=np.nan)
        y = values(x)
        return pd.Series(y).where(~np.isnan(y), None)

    return run


def logicle(T: float = 262144.0, W: float = 0.5, M: float = 4.5, A: float = 0.0) -> Callable[[Column], Column]:
    return _udf(lambda x: logicle_values(x, T, W, M, A))


def hyperlog(T: float = 262144.0, W: float = 0.5, M: float = 4.5, A: float = 0.0) -> Callable[[Column], Column]:
    return _udf(lambda x: hyperlog_values(x, T, W, M, A))


def biex(**shape: float) -> Callable[[Column], Column]:
    value, position = biex_table(**shape)
    return _udf(lambda x: np.where(np.isnan(x), np.nan, np.interp(x, value, position)))


def logicle_width(low_percentile: Column, T: float, M: float = 4.5) -> Column:
    """W from the fifth percentile of the negatives; 0.25 without negatives."""
    w = (F.lit(M) - F.log10(F.lit(T) / F.abs(low_percentile))) / 2
    return F.when(low_percentile.isNull() | (low_percentile >= 0), F.lit(0.25)).otherwise(F.greatest(F.lit(0.0), F.least(w, F.lit(min(M / 2, 2.0)))))


def logit(p, epsilon: float = 0.0):
    """Log odds of a share, kept `epsilon` away from 0 and 1; infinite there without it."""
    q = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), p)) if epsilon else p
    return F.when(q <= 0, F.lit(float("-inf"))).when(q >= 1, F.lit(float("inf"))).otherwise(F.log(q / (1 - q)))


def arcsine_root(p):
    return F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))


def bounded_scale(scale, low: float | None = None, high: float | None = None):
    """A scale whose values are kept between `low` and `high`."""

    def apply(x):
        y = scale(x)
        y = F.greatest(F.lit(low), y) if low is not None else y
        return F.least(F.lit(high), y) if high is not None else y

    return apply


def default_scale(kind, technology):
    """Name of the scale that a channel gets by its kind and the technology it was measured with."""
    return F.when(kind.isin("time", "scatter"), "linear").when(technology == "mass", "arcsinh").otherwise("logicle")
