"""Checks of acquisitions: flags per event or bin, combined per sample into shares, a score and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.common import clean, cut, join_groups
from strataflow.operators import ordered
from strataflow.operators.statistics import ratio


def bin_outliers(binned: DataFrame, by: list[str], value: str, times: float = 6.0) -> DataFrame:
    """Bins whose value lies more than `times` 1.4826 MAD from their group's median: the column `outlier`; false for empty bins."""
    x, binned = clean(F.col(value)), cut(binned)  # few rows, read four times
    middle = cut(ordered.quantiles(binned, by, {"x": x}, [0.5]).select(*by, F.col("q_x")[0].alias("_m")))
    away = join_groups(binned, middle, by)
    spread = ordered.quantiles(away, by, {"d": F.abs(x - F.col("_m"))}, [0.5]).select(*by, (1.4826 * F.col("q_d")[0]).alias("_s"))
    return join_groups(away, spread, by).withColumn("outlier", F.coalesce(F.abs(x - F.col("_m")) > times * F.col("_s"), F.lit(False))).drop("_m", "_s")


def long_runs(binned: DataFrame, by: list[str], flag: str, least: int) -> DataFrame:
    """The flag, set also in every run of fewer than `least` good bins between flagged ones (`removed`); runs follow the bins' order."""
    order = Window.partitionBy(*by).orderBy("bin")
    rows = binned.withColumn("_new", (F.col(flag) != F.coalesce(F.lag(flag).over(order), ~F.col(flag))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    sizes = rows.groupBy(*by, "_run").agg(F.count("*").alias("_n"))
    return join_groups(rows, sizes, [*by, "_run"]).withColumn("removed", F.col(flag) | (F.col("_n") < least)).drop("_new", "_run", "_n")


def summary(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Per group: rows, the share each check flags and flags alone, the share that any flags, and a score from 100 (none) down to 0. One scan."""
    hit = {name: F.coalesce(c, F.lit(False)) for name, c in flags.items()}
    together = sum((c.cast("int") for c in hit.values()), F.lit(0))
    percent = lambda c: ratio(F.count_if(c), F.count("*"), 100.0)
    own = [x for name, c in hit.items() for x in (percent(c).alias(f"{name}_percent"), percent(c & (together == 1)).alias(f"{name}_only"))]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *own, percent(together > 0).alias("flagged"))
    return out.withColumn("score", F.greatest(F.lit(0.0), 100.0 - F.col("flagged")))


def findings(summary: DataFrame, by: list[str], flags: list[str], much: float = 5.0) -> DataFrame:
    """A line per group and check whose share exceeds `much` percent, the worst first: `by`, `check`, `percent`, `rank`."""
    long = summary.unpivot(by, [f"{f}_percent" for f in flags], "check", "percent").where(F.col("percent") > much)
    order = Window.partitionBy(*by).orderBy(F.desc("percent"), "check")
    return long.select(*by, F.regexp_replace("check", "_percent$", "").alias("check"), "percent", F.row_number().over(order).alias("rank"))


def review_order(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows by how unusual their value is in their group: `score` (distance from the median in 1.4826 MAD), the largest first."""
    x = clean(F.col(value))
    middle = cut(ordered.quantiles(rows, by, {"x": x}, [0.5]).select(*by, F.col("q_x")[0].alias("_m")))  # a row per group
    away = join_groups(rows, middle, by)
    spread = ordered.quantiles(away, by, {"d": F.abs(x - F.col("_m"))}, [0.5]).select(*by, (1.4826 * F.col("q_d")[0]).alias("_s"))
    return join_groups(away, spread, by).withColumn("score", ratio(F.abs(x - F.col("_m")), F.col("_s"))).drop("_m", "_s").orderBy(F.desc_nulls_last("score"))
