"""Linear corrections of channels: compensation, unmixing, ratios and calibrated or computed channels.

A correction of n channels is n linear columns; zero coefficients are left out of the plan, and Catalyst
computes only the channels a query uses. Small matrices are inverted on the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators import ordered
from strataflow.operators.statistics import clean


def combine(channels: list[str], weights: list[float]) -> Column:
    terms = [F.col(c) * F.lit(float(w)) for c, w in zip(channels, weights) if w != 0]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def compensated(df: DataFrame, channels: list[str], spill: list[list[float]], suffix: str = "_comp") -> DataFrame:
    """comp_j = sum_i raw_i * inverse(spill)[i][j]."""
    inverse = np.linalg.inv(np.array(spill, float))
    return df.withColumns({c + suffix: combine(channels, inverse[:, j].tolist()) for j, c in enumerate(channels)})


def unmixed(df: DataFrame, detectors: list[str], spectra: dict[str, list[float]]) -> DataFrame:
    """Ordinary least squares abundances: raw Sᵀ (S Sᵀ)⁻¹, one linear column per spectrum."""
    s = np.array(list(spectra.values()), float)
    operator = s.T @ np.linalg.inv(s @ s.T)
    return df.withColumns({name: combine(detectors, operator[:, k].tolist()) for k, name in enumerate(spectra)})


def unmixed_nonnegative(df: DataFrame, detectors: list[str], spectra: dict[str, list[float]]) -> DataFrame:
    """Non-negative least squares per event by coordinate descent on the normal equations, in Arrow batches."""
    s = np.array(list(spectra.values()), float)
    gram = s @ s.T

    @F.pandas_udf("array<double>")
    def solve(values: pd.Series) -> pd.Series:
        raw = np.vstack(values.to_numpy())
        target = raw @ s.T
        x = np.zeros_like(target)
        for _ in range(500):
            before = x.copy()
            for k in range(len(gram)):
                x[:, k] = np.maximum(0.0, x[:, k] + (target[:, k] - x @ gram[k]) / gram[k, k])
            if np.abs(x - before).max(initial=0.0) <= 1e-10 * max(1.0, np.abs(x).max(initial=0.0)):
                break
        return pd.Series(list(x))

    out = df.withColumn("_x", solve(F.array(*[F.col(d).cast("double") for d in detectors])))
    return out.withColumns({name: F.col("_x")[k] for k, name in enumerate(spectra)}).drop("_x")


def residual(detectors: list[str], spectra: dict[str, list[float]]) -> Column:
    """Share of the signal that the abundances of `unmixed` do not explain."""
    off = [F.col(d) - reduce(lambda a, b: a + b, [F.col(n) * F.lit(float(s[k])) for n, s in spectra.items()]) for k, d in enumerate(detectors)]
    norm = lambda xs: F.sqrt(reduce(lambda a, b: a + b, [x * x for x in xs]))
    total = norm([F.col(d) for d in detectors])
    return F.when(total > 0, norm(off) / total)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: signed infinity for a / 0 and NaN for 0 / 0; null for null."""
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))
    return F.when(b != 0, a / b).when(b == 0, zero)


def ratio_channel(a: Column, b: Column, scale: float = 1.0, a_offset: float = 0.0, b_offset: float = 0.0) -> Column:
    """scale * (a - a_offset) / (b - b_offset)."""
    return F.lit(scale) * divide(a - F.lit(a_offset), b - F.lit(b_offset))


def calibrated(c: Column, slope: float, intercept: float) -> Column:
    """The odd power curve sign(x) e^intercept |x|^slope."""
    return F.signum(c) * F.lit(float(np.exp(intercept))) * F.pow(F.abs(c), F.lit(slope))


def spillover(df: DataFrame, control: str, positive: Column, channels: list[str]) -> DataFrame:
    """Spill from each control's own channel into the others: differences of medians of its positive and negative events.

    `control` names the channel that a control stains. One row per control and channel.
    """
    sides = {f"{c}_{k}": F.when(side, clean(F.col(c))) for c in channels for k, side in (("p", positive), ("n", ~positive))}
    wide = ordered.quantiles(df.where(F.col(control).isin(*channels)), [control], sides, [0.5])
    diff = lambda c: F.col(f"q_{c}_p")[0] - F.col(f"q_{c}_n")[0]
    own = F.coalesce(*[F.when(F.col(control) == c, diff(c)) for c in channels])
    return wide.select(control, F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.when(own != 0, diff(c) / own).alias("spill")) for c in channels])))


def spreading(df: DataFrame, control: str, positive: Column, channels: list[str]) -> DataFrame:
    """Spreading error sqrt(σ²₊ - σ²₋) / sqrt(ΔF) with σ = p84.13 - p50; null where the variance does not grow."""
    sides = {f"{c}_{k}": F.when(side, clean(F.col(c))) for c in channels for k, side in (("p", positive), ("n", ~positive))}
    wide = ordered.quantiles(df.where(F.col(control).isin(*channels)), [control], sides, [0.5, 0.8413])
    sigma = lambda c, k: F.col(f"q_{c}_{k}")[1] - F.col(f"q_{c}_{k}")[0]
    step = F.coalesce(*[F.when(F.col(control) == c, F.col(f"q_{c}_p")[0] - F.col(f"q_{c}_n")[0]) for c in channels])
    grown = lambda c: sigma(c, "p") * sigma(c, "p") - sigma(c, "n") * sigma(c, "n")
    rows = [F.struct(F.lit(c).alias("channel"), F.when((grown(c) >= 0) & (step > 0), F.sqrt(grown(c)) / F.sqrt(step)).alias("spread")) for c in channels]
    return wide.select(control, F.inline(F.array(*rows)))
