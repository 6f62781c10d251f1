"""Comparisons of distributions and groups: distances, effect sizes, test statistics.

Everything reduces to sufficient statistics or to cumulative counts per distinct value (see `ordered`), so
no group is gathered in one task. Statistics come as columns; p values are looked up afterwards with the
distribution functions of `functions.special` on the few result rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.common import join_groups
from strataflow.operators import ordered
from strataflow.operators.statistics import clean, ratio


def ks(df: DataFrame, by: list[str], value: str, control: Column, test: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D."""
    return ordered.steps(df, by, value, control, test).groupBy(*by).agg(F.max(F.abs(F.col("c") - F.col("t"))).alias("d"))


def overton(df: DataFrame, by: list[str], value: str, control: Column, test: Column) -> DataFrame:
    """Percent positive by cumulative subtraction."""
    return ordered.steps(df, by, value, control, test).groupBy(*by).agg((100.0 * F.greatest(F.lit(0.0), F.max(F.col("c") - F.col("t")))).alias("percent"))


def wasserstein(df: DataFrame, by: list[str], value: str, control: Column, test: Column) -> DataFrame:
    """Area between the two cumulative distributions."""
    area = F.abs(F.col("c") - F.col("t")) * (F.col("next_value") - F.col(value))
    return ordered.steps(df, by, value, control, test).groupBy(*by).agg(F.sum(area).alias("distance"))


def jensen_shannon(df: DataFrame, channel: str, low: float, high: float, bins: int, control: Column, test: Column) -> DataFrame:
    """Jensen-Shannon divergence (bits) of two histograms, one row."""
    x = clean(F.col(channel))
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - low) / (high - low) * bins)))
    cells = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count_if(control).alias("a"), F.count_if(test).alias("b"))
    total = Window.partitionBy()  # over at most `bins` rows
    p, q = F.col("a") / F.sum("a").over(total), F.col("b") / F.sum("b").over(total)
    rows = cells.select(p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.when(F.col(x) > 0, F.col(x)) / F.col("m"))).otherwise(0.0)
    return rows.agg(((F.sum(term("p")) + F.sum(term("q"))) / 2).alias("divergence"))


def probability_bins(df: DataFrame, channel: str, bins: int, control: Column, test: Column) -> DataFrame:
    """Bins of equal control population (right-closed): chi square, T and percent positive, one row."""
    x = clean(F.col(channel))
    cuts = ordered.quantiles(df.where(control), [], {"x": x}, [k / bins for k in range(1, bins)]).select(F.col("q_x").alias("cuts"))
    rows = df.where(x.isNotNull() & (control | test)).crossJoin(F.broadcast(cuts))  # one row of bins - 1 cuts
    cells = rows.groupBy(F.size(F.filter("cuts", lambda c: c < x)).alias("bin")).agg(F.count_if(control).alias("a"), F.count_if(test).alias("b"))
    total = Window.partitionBy()
    shares = cells.select((F.col("a") / F.sum("a").over(total)).alias("c"), (F.col("b") / F.sum("b").over(total)).alias("s"), F.sum("a").over(total).alias("na"), F.sum("b").over(total).alias("nb"))
    k = F.least(F.max("na"), F.max("nb"))
    chi = F.sum(F.when(F.col("c") + F.col("s") > 0, F.pow(F.col("c") - F.col("s"), 2) / (F.col("c") + F.col("s"))).otherwise(0.0))
    return shares.agg(chi.alias("chi2"), F.greatest(F.lit(0.0), (chi - bins / k) / (F.sqrt(F.lit(float(bins))) / k)).alias("t"), (100 * F.sum(F.greatest(F.lit(0.0), F.col("s") - F.col("c")))).alias("positive"))


def moments(df: DataFrame, by: list[str], group: str, channel: str) -> DataFrame:
    """n, mean and sample variance per group: the sufficient statistics of the tests below."""
    x = clean(F.col(channel))
    return df.groupBy(*by, group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).where("n > 0")


def two_sample(df: DataFrame, by: list[str], group: str, channel: str, a, b) -> DataFrame:
    """Welch and Student t with degrees of freedom, Cohen's d and fold change of group `a` against `b`."""
    own = moments(df, by, group, channel)
    pick = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c)))
    t = own.groupBy(*by).agg(*[pick(c, g).alias(f"{c}{k}") for c in ("n", "m", "v") for k, g in (("1", a), ("2", b))])
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    e1, e2 = v1 / n1, v2 / n2
    pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    return t.select(
        *by,
        ratio(m1 - m2, F.sqrt(e1 + e2)).alias("welch_t"),
        ratio((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, n1 - 1) + F.try_divide(e2 * e2, n2 - 1)).alias("welch_df"),
        ratio(m1 - m2, F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("student_t"),
        ratio(m1 - m2, F.sqrt(pooled)).alias("cohens_d"),
        ratio(m1, m2).alias("fold_change"),
    )


def paired(df: DataFrame, pair: str, group: str, channel: str, a, b) -> DataFrame:
    """Paired t of the pairs' means in two groups; pairs without both are dropped. One row."""
    x = clean(F.col(channel))
    pairs = df.groupBy(pair).agg(F.avg(F.when(F.col(group) == a, x)).alias("a"), F.avg(F.when(F.col(group) == b, x)).alias("b"))
    d = F.col("a") - F.col("b")
    return pairs.where(d.isNotNull()).agg(F.count("*").alias("pairs"), ratio(F.avg(d), F.try_divide(F.stddev_samp(d), F.sqrt(F.count("*")))).alias("paired_t"))


def anova(df: DataFrame, by: list[str], group: str, channel: str) -> DataFrame:
    """One-way F with its degrees of freedom, from the groups' moments."""
    own = moments(df, by, group, channel)
    whole = own.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_grand"), F.sum("n").alias("_total"), F.count("*").alias("_k"))
    joined = join_groups(own, whole, by)
    between = F.sum(F.col("n") * (F.col("m") - F.col("_grand")) * (F.col("m") - F.col("_grand")))
    within = F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0)))
    return joined.groupBy(*by).agg(between.alias("_b"), within.alias("_w"), F.max("_k").alias("_k"), F.max("_total").alias("_n")).select(
        *by, (F.col("_k") - 1).alias("df_between"), (F.col("_n") - F.col("_k")).alias("df_within"), ratio(F.try_divide(F.col("_b"), F.col("_k") - 1), F.try_divide(F.col("_w"), F.col("_n") - F.col("_k"))).alias("f")
    )


def welch_anova(df: DataFrame, group: str, channel: str) -> DataFrame:
    """Welch's F for unequal variances, one row."""
    own = moments(df, [], group, channel).where("v > 0").withColumn("w", F.col("n") / F.col("v"))
    whole = own.agg(F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("grand"), F.count("*").alias("k"))
    rows = own.crossJoin(F.broadcast(whole))  # one row
    k = F.max("k")
    lack = F.sum(F.try_divide((1 - F.col("w") / F.col("sw")) * (1 - F.col("w") / F.col("sw")), F.col("n") - 1))
    between = F.try_divide(F.sum(F.col("w") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))), k - 1)
    return rows.agg(F.try_divide(between, 1 + F.try_divide(2 * (k - 2), k * k - 1) * lack).alias("f"), (k - 1).alias("df_between"), F.try_divide(k * k - 1, 3 * lack).alias("df_within"))


def mann_whitney(df: DataFrame, by: list[str], group: str, channel: str, a, b) -> DataFrame:
    """U of group `a` and its normal score with tie correction and continuity."""
    ranks = ordered.average_ranks(df.where(F.col(group).isin(a, b)), by, channel, group)
    own = ranks.groupBy(*by).agg(
        F.sum(F.when(F.col(group) == a, F.col("rank") * F.col("n")).otherwise(0.0)).alias("_r"),
        F.sum(F.when(F.col(group) == a, F.col("n")).otherwise(0)).alias("_m"),
        F.sum(F.when(F.col(group) == b, F.col("n")).otherwise(0)).alias("_k"),
        F.sum((F.col("ties").cast("double") * F.col("ties") - 1) * F.col("n")).alias("_tie"),
    )
    m, k = F.col("_m").cast("double"), F.col("_k").cast("double")
    u = F.col("_r") - m * (m + 1) / 2
    off = u - m * k / 2
    spread = F.sqrt(m * k / 12 * (m + k + 1 - F.try_divide(F.col("_tie"), (m + k) * (m + k - 1))))
    return own.select(*by, u.alias("u"), ratio(off - F.signum(off) * 0.5, spread).alias("z"))


def kruskal(df: DataFrame, group: str, channel: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, one row."""
    ranks = ordered.average_ranks(df, [], channel, group)
    own = ranks.groupBy(group).agg(F.sum(F.col("rank") * F.col("n")).alias("r"), F.sum("n").alias("n"), F.sum((F.col("ties").cast("double") * F.col("ties") - 1) * F.col("n")).alias("tie"))
    n = F.sum("n").cast("double")
    h = F.try_divide(F.lit(12.0), n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)
    return own.agg(F.try_divide(h, 1 - F.try_divide(F.sum("tie"), n * n * n - n)).alias("h"), (F.count("*") - 1).alias("df"))


def correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    both = df.where(clean(F.col(x)).isNotNull() & clean(F.col(y)).isNotNull())
    return both.groupBy(*by).agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).count()


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi square, its degrees of freedom and Cramér's V of two categories, one row."""
    cells = contingency(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    rows, columns = cells.groupBy(a).agg(F.sum("count").alias("ra")), cells.groupBy(b).agg(F.sum("count").alias("cb"))
    n = cells.agg(F.sum("count").alias("n"))
    # chi² = n (sum o² / (r c) - 1), so empty cells need no rows
    parts = cells.join(rows, a).join(columns, b).agg(F.sum(F.col("count") * F.col("count") / (F.col("ra").cast("double") * F.col("cb"))).alias("s"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    chi = F.col("n") * (F.col("s") - 1)
    small = F.least(F.col("r"), F.col("c")) - 1
    return parts.crossJoin(n).select(chi.alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), F.when(small > 0, F.sqrt(chi / (F.col("n") * small))).alias("cramers_v"))


def adjusted(tests: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg and Holm adjusted p values of a family of tests (one row per test); tests without p are none of the family.

    Equal p values have equal adjusted ones, so they are found per distinct p, and no task holds a family.
    """
    key = ["_g"] if by else []
    rows = tests.withColumn("_g", F.to_json(F.struct(*by))) if by else tests  # null is a group like any other
    counted = rows.where(F.col(p).isNotNull()).groupBy(*key, p).agg(F.count("*").alias("_n"))
    ranked = join_groups(ordered.cumulative(counted, key, p, ["_n"]), counted.groupBy(*key).agg(F.sum("_n").alias("_all")), key)
    bh, holm = F.col(p) * F.col("_all") / F.col("cum__n"), F.col(p) * (F.col("_all") - F.col("cum__n") + F.col("_n"))
    scored = ordered.bucketed(ranked.select(*key, p, bh.alias("_b"), holm.alias("_h")), key, p)
    # Running min from above and max from below: over the few buckets of a family, then inside each bucket.
    over, inside = Window.partitionBy(*key).orderBy("bucket"), Window.partitionBy(*key, "bucket").orderBy(p)
    totals = scored.groupBy(*key, "bucket").agg(F.min("_b").alias("_low"), F.max("_h").alias("_high"))
    offsets = totals.select(
        *key, "bucket", F.min("_low").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"), F.max("_high").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")
    )
    least = F.least(F.lit(1.0), F.min("_b").over(inside.rowsBetween(0, Window.unboundedFollowing)), "_after")
    most = F.least(F.lit(1.0), F.greatest(F.max("_h").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_before"))
    found = scored.join(offsets, [*key, "bucket"]).select(*key, p, least.alias("bh"), most.alias("holm"))
    return join_groups(rows, found, [*key, p]).drop("_g")


def sed(df: DataFrame, by: list[str], value: str, control: Column, test: Column) -> DataFrame:
    """Percent positive by enhanced normalised subtraction of the two cumulative distributions."""
    rows = ordered.steps(df, by, value, control, test)
    first = rows.groupBy(*by).agg(F.max_by(F.struct(F.col(value).alias("x"), "c", "t"), F.struct(F.col("c") - F.col("t"), -F.col(value))).alias("d"))
    near = join_groups(rows, first, by).where((F.col(value) <= F.col("d.x")) & (F.col("d.c") > 0) & (F.col("d.t") > 0))
    lead = F.col("c") / F.col("d.c") - F.col("t") / F.col("d.t")
    second = near.groupBy(*by).agg(F.max_by(F.struct("c", "t"), F.struct(lead, -F.col(value))).alias("s"))
    both = join_groups(first, second, by)
    c, t, c2, t2 = F.col("d.c"), F.col("d.t"), F.coalesce(F.col("s.c"), F.lit(0.0)), F.coalesce(F.col("s.t"), F.lit(0.0))
    return both.select(*by, (100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(c - t, c) + ratio(c2 * t - c * t2, c * c)))).alias("percent"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks."""
    both = df.where(clean(F.col(x)).isNotNull() & clean(F.col(y)).isNotNull()).select(*by, x, y)
    for c in (x, y):
        counted = both.groupBy(*by, c).agg(F.count("*").alias("_n"))
        ranks = ordered.cumulative(counted, by, c, ["_n"]).select(*by, c, (F.col("cum__n") - (F.col("_n") - 1) / 2).alias(f"_r_{c}"))
        both = join_groups(both, ranks, [*by, c])
    return both.groupBy(*by).agg(F.corr(f"_r_{x}", f"_r_{y}").alias("spearman"))


def friedman(df: DataFrame, block: str, group: str, channel: str, levels: list) -> DataFrame:
    """Friedman's chi square over the blocks' mean per level (complete blocks only), one row. A block has one row per level."""
    means = df.where(F.col(group).isin(*levels)).groupBy(block, group).agg(F.avg(clean(F.col(channel))).alias("m")).where("m IS NOT NULL")
    inside = Window.partitionBy(block)
    ties = F.count("*").over(Window.partitionBy(block, "m"))
    ranked = means.withColumns({"k": F.count("*").over(inside), "rank": F.rank().over(inside.orderBy("m")) + (ties - 1) / 2}).where(F.col("k") == len(levels))
    sums = ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    k = len(levels)
    return sums.agg((F.try_divide(F.lit(12.0), F.max("n") * k * (k + 1)) * F.sum(F.col("r") * F.col("r")) - 3 * F.max("n") * (k + 1)).alias("chi2"), F.lit(k - 1).alias("df"))


def regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    a, b = clean(F.col(y)), clean(F.col(x))
    return df.groupBy(*by).agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))


def bootstrap_mean(df: DataFrame, by: list[str], key: list[str], channel: str, replicates: int = 100, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean from Poisson weights, all replicates in one scan.

    A row's weights come from the hash of its key, so they do not depend on how rows are spread. Each batch
    sums its weights per group and replicate; only those sums are shuffled.
    """
    ends = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    rows = df.where(clean(F.col(channel)).isNotNull()).select(*by, clean(F.col(channel)).alias("_x"), F.xxhash64(F.lit(seed), *key).alias("_h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in batches:
            mixed = pdf["_h"].to_numpy().astype(np.uint64)[:, None] ^ salt
            for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
                mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
            weight = np.searchsorted(ends, (mixed >> np.uint64(11)).astype(float) / float(1 << 53), side="right").astype(float)
            for _, part in pdf.groupby(by, dropna=False, sort=False).indices.items() if by else [(None, np.arange(len(pdf)))]:
                w, x = weight[part], pdf["_x"].to_numpy()[part]
                out = pd.DataFrame({"_r": np.arange(replicates), "_w": w.sum(axis=0), "_s": x @ w})
                for c in by:
                    out[c] = [pdf[c].iloc[part[0]]] * replicates
                yield out[[*by, "_r", "_w", "_s"]]

    kinds = dict(df.dtypes)
    sums = rows.mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], "_r int, _w double, _s double"]))
    means = sums.groupBy(*by, "_r").agg((F.sum("_s") / F.sum("_w")).alias("m")).groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("m"))  # one number a replicate
    whole = rows.groupBy(*by).agg(F.avg("_x").alias("mean"))
    out = join_groups(whole, means, by)
    at = lambda q: F.try_element_at("m", F.lit(1 + int(round(q * (replicates - 1)))))
    return out.select(*by, "mean", at(0.025).alias("low"), at(0.975).alias("high"))
