"""Assay computations over grouped events: dose curves, codes, normalisation, outlying rates, sampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.common import clean, cut, join_groups
from strataflow.functions import special
from strataflow.operators import ordered
from strataflow.operators.statistics import ratio


def z_prime(df: DataFrame, by: list[str], channel: str, positive: Column, negative: Column) -> DataFrame:
    """1 - 3 (sd₊ + sd₋) / |m₊ - m₋|."""
    x = clean(F.col(channel))
    p, n = F.when(positive, x), F.when(negative, x)
    return df.groupBy(*by).agg((1 - ratio(3 * (F.stddev_samp(p) + F.stddev_samp(n)), F.abs(F.avg(p) - F.avg(n)))).alias("z_prime"))


def robust_z_prime(df: DataFrame, by: list[str], channel: str, positive: Column, negative: Column) -> DataFrame:
    """As `z_prime`, with medians for means and 1.4826 MAD for standard deviations."""
    x = clean(F.col(channel))
    rows = df.select(*by, F.when(positive, x).alias("_p"), F.when(negative, x).alias("_n"))
    middle = cut(ordered.quantiles(rows, by, {"p": F.col("_p"), "n": F.col("_n")}, [0.5]).select(*by, F.col("q_p")[0].alias("_mp"), F.col("q_n")[0].alias("_mn")))  # a row per group
    away = ordered.quantiles(join_groups(rows, middle, by), by, {"p": F.abs(F.col("_p") - F.col("_mp")), "n": F.abs(F.col("_n") - F.col("_mn"))}, [0.5])
    both = join_groups(middle, away, by)
    return both.select(*by, (1 - ratio(3 * 1.4826 * (F.col("q_p")[0] + F.col("q_n")[0]), F.abs(F.col("_mp") - F.col("_mn")))).alias("z_prime"))


def proliferation(df: DataFrame, by: list[str], generation: str) -> DataFrame:
    """Division, proliferation, expansion and replication index and percent divided, from counts per generation (0 for undivided)."""
    counts = df.where(F.col(generation).isNotNull()).groupBy(*by, F.col(generation).alias("g")).count()
    p = F.col("count") / F.pow(F.lit(2.0), F.col("g"))
    on = lambda x: F.sum(F.when(F.col("g") > 0, x).otherwise(0.0))
    return counts.groupBy(*by).agg(
        (F.sum(F.col("g") * p) / F.sum(p)).alias("division"),
        ratio(F.sum(F.col("g") * p), on(p)).alias("proliferation"),
        (F.sum("count") / F.sum(p)).alias("expansion"),
        ratio(on(F.col("count")), on(p)).alias("replication"),
        (100 * on(p) / F.sum(p)).alias("divided"),
    )


def codes(df: DataFrame, channels: list[Column], k: int, names: list[str]) -> DataFrame:
    """The k brightest channels of each event as a code ("1+4+6"), and how far the last of them is above the next."""
    ranked = F.array_sort(F.array(*[F.struct((-c).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (c, n) in enumerate(zip(channels, names))]))
    top = F.array_sort(F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["i"].alias("i"), s["n"].alias("n"))))
    return df.withColumn("_r", ranked).withColumns({"code": F.array_join(F.transform(top, lambda s: s["n"]), "+"), "separation": F.col("_r")[k]["v"] - F.col("_r")[k - 1]["v"]}).drop("_r")


def quantile_normalised(df: DataFrame, batch: str, channel: str, levels: int = 31) -> DataFrame:
    """`normalised`: each batch's quantiles mapped to the batches' mean quantiles, linear between and beyond them by a shift."""
    own = ordered.quantiles(df, [batch], {"x": clean(F.col(channel))}, [(k + 1) / (levels + 1) for k in range(levels)]).select(batch, F.col("q_x").alias("_q"))
    goal = own.select(F.posexplode("_q").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v"))
    goal = goal.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("_g"))  # one row of `levels` numbers
    rows = df.join(own.crossJoin(F.broadcast(goal)), batch)
    x = clean(F.col(channel))
    at = F.size(F.filter("_q", lambda v: v <= x))  # quantiles at or below the value
    low, high = F.get("_q", at - 1), F.get("_q", at)
    to_low, to_high = F.get("_g", at - 1), F.get("_g", at)
    mapped = F.when(at == 0, x + (F.col("_g")[0] - F.col("_q")[0])).when(at == levels, x + (to_low - low)).otherwise(to_low + (x - low) / (high - low) * (to_high - to_low))
    return rows.withColumn("normalised", mapped).drop("_q", "_g")


def log_logistic(x: np.ndarray, b: float, c: float, d: float, e: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return c + (d - c) / (1 + np.exp(b * (np.log(x) - np.log(e))))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float, float, float]:
    """Weighted least squares of the four-parameter log-logistic curve by damped Gauss-Newton: b, c, d, e and the residual sum."""
    order = np.argsort(x)
    x, y, weight = x[order], y[order], weight[order]
    edge = max(1, len(y) // 5)
    p = np.array([1.0 if y[:edge].mean() > y[-edge:].mean() else -1.0, y.min(), y.max(), math.log(np.median(x))])

    def off(p):
        return np.sqrt(weight) * (y - log_logistic(x, p[0], p[1], p[2], math.exp(min(p[3], 700))))

    damp, r = 1e-2, off(p)
    for _ in range(300):
        jac = np.empty((len(x), 4))
        for k in range(4):
            step = np.zeros(4)
            step[k] = 1e-6 * max(1.0, abs(p[k]))
            jac[:, k] = (off(p + step) - off(p - step)) / (2 * step[k])
        gram = jac.T @ jac
        move = -np.linalg.lstsq(gram + damp * np.diag(np.diag(gram) + 1e-12), jac.T @ r, rcond=None)[0]
        new = off(p + move)
        if np.isfinite(new).all() and new @ new < r @ r:
            done = r @ r - new @ new < 1e-12 * (r @ r)
            p, r, damp = p + move, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p[0], p[1], p[2], math.exp(min(p[3], 700)), float(r @ r)


def dose_response(df: DataFrame, by: str, dose: str, response: str) -> DataFrame:
    """A fitted curve per group. Responses are averaged per dose first, so the fit sees one row per dose, however many events there are."""
    x = clean(F.col(response))
    means = df.where((F.col(dose) > 0) & x.isNotNull()).groupBy(by, F.col(dose).cast("double").alias("dose")).agg(F.avg(x).alias("mean"), F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 4:
            return pd.DataFrame(columns=["key", "b", "low", "high", "ec50", "residual"])
        values = fit_curve(pdf["dose"].to_numpy(), pdf["mean"].to_numpy(), pdf["n"].to_numpy(float))
        return pd.DataFrame([(pdf[by].iloc[0], *values)], columns=["key", "b", "low", "high", "ec50", "residual"])

    kind = dict(df.dtypes)[by]
    return means.groupBy(by).applyInPandas(fit, f"key {kind}, b double, low double, high double, ec50 double, residual double").withColumnRenamed("key", by)


def _extremes(x: np.ndarray, most: float, alpha: float) -> np.ndarray:
    """Places of the outliers of the robust generalised extreme deviate test.

    The value farthest from the median of those left lies at one end of the sorted values, so what is left is always one
    stretch of them, and its MAD is found by bisection. A value counts if its deviation exceeds the critical value of its step or a later one does.
    """
    order = np.argsort(x, kind="stable")
    v, low, high, last, taken = x[order], 0, len(x), 0, []
    for k in range(int(len(x) * most)):
        left = v[low:high]
        n = len(left)
        if n < 3:
            break
        middle = (left[(n - 1) // 2] + left[n // 2]) / 2
        # The MAD merges the distances below and above the median, both sorted.
        spread = 1.4826 * _middle_of(middle - left[: n // 2][::-1], left[n // 2 :] - middle)
        if spread == 0:
            break
        down = middle - left[0] > left[-1] - middle
        score = max(middle - left[0], left[-1] - middle) / spread
        taken.append(low if down else high - 1)
        low, high = (low + 1, high) if down else (low, high - 1)
        t = float(special.student_quantile(1 - alpha / (2 * n), n - 2)) if n <= _SMALL else float(special.normal_quantile(1 - alpha / (2 * n)))
        if score > t * (n - 1) / math.sqrt((n - 2 + t * t) * n):
            last = k + 1
    return np.sort(order[taken[:last]])


#: Values from which the normal quantile stands for Student's.
_SMALL = 2000


def _middle_of(a: np.ndarray, b: np.ndarray) -> float:
    """Median of the values of two sorted arrays."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    n = len(both)
    return (both[(n - 1) // 2] + both[n // 2]) / 2


def outlying_slices(slices: DataFrame, by: str, most: float = 0.2, alpha: float = 0.01) -> DataFrame:
    """Slices (`slice`, `count`) whose rate is off by the robust generalised extreme deviate test at level `alpha`: the farthest slice is taken
    away and median and MAD found again, up to the share `most`, each held against the test's own critical value. Slices are counts, few per group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[_extremes(pdf["count"].to_numpy(float), most, alpha)][[by, "slice", "count"]]

    kinds = dict(slices.dtypes)
    return slices.select(by, "slice", "count").groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, slice {kinds['slice']}, count {kinds['count']}")


def sampled(df: DataFrame, by: list[str], key: list[str], k: int, seed: int = 1) -> DataFrame:
    """k rows of each group, the same for the same seed: those with the smallest hashes. A hot group is cut down per bucket before it meets in one task."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_b", F.pmod(F.shiftright("_h", 8), F.lit(64)))
    first = hashed.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *key))).where(F.col("_n") <= k)
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h", *key))).where(F.col("_n") <= k).drop("_h", "_b", "_n")


def sampled_share(df: DataFrame, key: list[str], share: float, seed: int = 1) -> DataFrame:
    """Every row whose hash lies in the first `share` of all hashes: a sample of about that share, the same for the same seed, without a shuffle."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) < int(share * (1 << 30)))


def quotas(df: DataFrame, by: str, per_group: int, total: int) -> DataFrame:
    """Rows to take of each group: at most `per_group`, scaled down together to `total`."""
    counts = df.groupBy(by).count().withColumn("want", F.least(F.col("count"), F.lit(per_group)))
    whole = counts.agg(F.sum("want").alias("w"))
    return counts.crossJoin(F.broadcast(whole)).select(by, "count", F.when(F.col("w") <= total, F.col("want")).otherwise(F.floor(F.col("want") * total / F.col("w"))).cast("long").alias("quota"))  # one row
