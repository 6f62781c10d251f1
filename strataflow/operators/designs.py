"""Tests chosen by a design, and fits of models, from sufficient statistics and cumulative counts.

Rows are aggregated first, so that what is left for numpy is one row per test, level or term. Values that are
null, NaN or infinite are dropped; tests without enough values give null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.common import clean, join_groups
from strataflow.functions import special
from strataflow.operators import compare, ordered
from strataflow.operators.statistics import ratio

#: Exact rank distributions are used for two groups of fewer rows than this, without ties.
EXACT = 50


def one_sample(df: DataFrame, by: list[str], channel: str, mean: float = 0.0) -> DataFrame:
    """t of each group's mean against `mean`, its degrees of freedom and standard error."""
    x = clean(F.col(channel))
    own = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x))).alias("se"))
    return own.select(*by, "mean", "se", ratio(F.col("mean") - mean, F.col("se")).alias("t"), (F.col("n") - 1).alias("df"))


def with_interval(tests: DataFrame, estimate: str, se: str, df: str, level: float = 0.95) -> DataFrame:
    """`low` and `high` of an estimate with a t distribution, and the two-sided `p` of its being 0."""
    t = special.column(lambda d: special.student_quantile((1 + level) / 2, d))(F.col(df))
    p = special.column(special.student_two_sided)(ratio(F.col(estimate), F.col(se)), F.col(df))
    return tests.withColumns({"low": F.col(estimate) - t * F.col(se), "high": F.col(estimate) + t * F.col(se), "p": p})


def pairs_of(df: DataFrame, pair: str, group: str, channel: str, levels: list) -> DataFrame:
    """One row per pair key with its mean in each of the `levels` (columns x0, x1, ...); keys without all of them are dropped."""
    x = clean(F.col(channel))
    wide = df.where(F.col(group).isin(*levels) & F.col(pair).isNotNull()).groupBy(pair).agg(*[F.avg(F.when(F.col(group) == g, x)).alias(f"x{k}") for k, g in enumerate(levels)])
    return wide.dropna(subset=[f"x{k}" for k in range(len(levels))])


def signed_rank(pairs: DataFrame, a: str = "x0", b: str = "x1") -> DataFrame:
    """Wilcoxon's W+ of the pairs' differences (zeros dropped), its number of pairs and its normal score with ties and continuity. One row."""
    d = F.col(a) - F.col(b)
    rows = pairs.where(d != 0).select(F.abs(d).alias("size"), (d > 0).alias("up"))
    ranks = ordered.average_ranks(rows, [], "size", "up")
    own = ranks.agg(F.sum(F.when(F.col("up"), F.col("rank") * F.col("n")).otherwise(0.0)).alias("w"), F.sum("n").cast("double").alias("n"), F.sum((F.col("ties").cast("double") * F.col("ties") - 1) * F.col("n")).alias("tie"))
    n, off = F.col("n"), F.col("w") - F.col("n") * (F.col("n") + 1) / 4
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    return own.select("w", n.cast("long").alias("pairs"), ratio(off - F.signum(off) * 0.5, spread).alias("z"))


def _exact_u(u: float, n: int, m: int) -> float:
    """Two-sided p of U without ties: the number of ways to draw each sum, by adding one row at a time."""
    ways = np.zeros((n + 1, n * m + 1))
    ways[0, 0] = 1
    for j in range(1, n + m + 1):  # rank j is drawn for the first group or not
        for k in range(min(j, n), 0, -1):
            shift = j - k  # rows of the other group below it
            if shift <= m:
                ways[k, shift:] += ways[k - 1, : n * m + 1 - shift]
    shares = ways[n] / ways[n].sum()
    return float(min(1.0, 2 * min(shares[: int(u) + 1].sum(), shares[int(u) :].sum())))


def mann_whitney_p(df: DataFrame, by: list[str], group: str, channel: str, a, b) -> DataFrame:
    """U with its p: exact for groups of fewer than EXACT rows without ties, else from the normal score."""
    x = clean(F.col(channel))
    sizes = df.where(F.col(group).isin(a, b)).groupBy(*by).agg(F.count(F.when(F.col(group) == a, x)).alias("n"), F.count(F.when(F.col(group) == b, x)).alias("m"))
    ties = df.where(F.col(group).isin(a, b) & x.isNotNull()).groupBy(*by, x.alias("_x")).agg(F.count("*").alias("_k")).groupBy(*by).agg(F.max("_k").alias("most"))
    rows = join_groups(join_groups(compare.mann_whitney(df, by, group, channel, a, b), sizes, by), ties, by)

    def p(u, z, n, m, most):
        exact = (n < EXACT) & (m < EXACT) & (most == 1)
        return np.array([_exact_u(*t[:3]) if t[3] else t[4] for t in zip(u, n.astype(int), m.astype(int), exact, special.normal_two_sided(z))])

    return rows.select(*by, "u", "n", "m", special.column(p)(F.col("u"), F.coalesce("z", F.lit(0.0)), F.col("n"), F.col("m"), F.col("most")).alias("p"))


def fisher(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """Fisher's exact test of two yes/no columns per group: the four counts, the odds ratio and the two-sided p (all tables no likelier than the one seen)."""
    cells = df.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(*[F.count_if(x & y).alias(n) for n, x, y in (("both", a, b), ("first", a, ~b), ("second", ~a, b), ("none", ~a, ~b))])

    def p(both, first, second, none):
        out = []
        for w, x, y, z in zip(both, first, second, none):
            row, column, n = w + x, w + y, w + x + y + z
            k = np.arange(max(0, row + column - n), min(row, column) + 1)
            f = special.log_gamma
            log = f(np.array([row + 1, n - row + 1, column + 1, n - column + 1])).sum() - f(n + 1) - f(k + 1) - f(row - k + 1) - f(column - k + 1) - f(n - row - column + k + 1)
            here = log[int(w - k[0])]
            out.append(min(1.0, np.exp(log[log <= here + 1e-7]).sum()))
        return np.array(out)

    return cells.select(*by, "both", "first", "second", "none", ratio(F.col("both") * F.col("none"), F.col("first") * F.col("second")).alias("odds"), special.column(p)(*[F.col(c) for c in ("both", "first", "second", "none")]).alias("p"))


def level_pairs(df: DataFrame, group: str, channel: str) -> DataFrame:
    """Welch's t of every two levels of a group (their moments are few rows), its degrees of freedom and the difference of means."""
    own = compare.moments(df, [], group, channel)
    a = own.select(F.col(group).alias("a"), *[F.col(c).alias(f"{c}1") for c in ("n", "m", "v")])
    b = own.select(F.col(group).alias("b"), *[F.col(c).alias(f"{c}2") for c in ("n", "m", "v")])
    rows = a.join(b, F.col("a") < F.col("b"))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return rows.select("a", "b", (F.col("m1") - F.col("m2")).alias("difference"), ratio(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2)).alias("t"), ratio((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, F.col("n1") - 1) + F.try_divide(e2 * e2, F.col("n2") - 1)).alias("df"))


def post_hoc(df: DataFrame, group: str, channel: str) -> DataFrame:
    """`level_pairs` with p values and their Holm and Benjamini-Hochberg adjustment over all pairs."""
    rows = level_pairs(df, group, channel).withColumn("p", special.column(special.student_two_sided)(F.col("t"), F.col("df")))
    return compare.adjusted(rows, "p")


#: Design -> the parametric test and the one of ranks.
DESIGNS = {"two": ("welch", "mann-whitney"), "paired two": ("paired t", "wilcoxon"), "several": ("welch anova", "kruskal-wallis"), "repeated": ("block anova", "friedman")}


def design_of(levels: int, paired: bool) -> str:
    if levels < 2:
        raise ValueError("a comparison needs two levels")
    return {(True, False): "two", (True, True): "paired two", (False, False): "several", (False, True): "repeated"}[levels == 2, paired]


def analysed(df: DataFrame, group: str, channel: str, pair: str | None = None) -> DataFrame:
    """Both tests that fit the design: `design`, `test`, `statistic`. The levels (few) are read first; with a `pair` column they are measured in the same subjects."""
    levels = sorted(r[0] for r in df.where(F.col(group).isNotNull() & clean(F.col(channel)).isNotNull()).select(group).distinct().collect())
    design = design_of(len(levels), pair is not None)
    kept = df.where(F.col(group).isNotNull())
    if design == "two":
        found = compare.two_sample(kept, [], group, channel, *levels).select("welch_t"), compare.mann_whitney(kept, [], group, channel, *levels).select("u")
    elif design == "paired two":
        found = compare.paired(kept, pair, group, channel, *levels).select("paired_t"), signed_rank(pairs_of(kept, pair, group, channel, levels)).select("w")
    elif design == "several":
        found = compare.welch_anova(kept, group, channel).select("f"), compare.kruskal(kept, group, channel).select("h")
    else:
        found = block_anova(kept, pair, group, channel, levels).select("f"), compare.friedman(kept, pair, group, channel, levels).select("chi2")
    rows = [one.select(F.lit(design).alias("design"), F.lit(test).alias("test"), F.col(one.columns[0]).cast("double").alias("statistic")) for test, one in zip(DESIGNS[design], found)]
    return rows[0].unionByName(rows[1])


def block_anova(df: DataFrame, block: str, group: str, channel: str, levels: list) -> DataFrame:
    """F of the levels within complete blocks (one mean per block and level), with its degrees of freedom. One row."""
    k = len(levels)
    wide = pairs_of(df, block, group, channel, levels)
    own = wide.select(*[f"x{i}" for i in range(k)], (sum((F.col(f"x{i}") for i in range(k)), F.lit(0.0)) / k).alias("row"))
    sums = own.agg(F.count("*").alias("n"), F.avg("row").alias("grand"), F.var_pop("row").alias("rows"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)], *[F.var_pop(f"x{i}").alias(f"v{i}") for i in range(k)])
    n, grand = F.col("n"), F.col("grand")
    between = n * sum(((F.col(f"m{i}") - grand) * (F.col(f"m{i}") - grand) for i in range(k)), F.lit(0.0))
    total = n * sum((F.col(f"v{i}") + (F.col(f"m{i}") - grand) * (F.col(f"m{i}") - grand) for i in range(k)), F.lit(0.0))
    error = total - between - k * n * F.col("rows")
    return sums.select(ratio(between / (k - 1), F.try_divide(error, (k - 1) * (n - 1))).alias("f"), F.lit(k - 1).alias("df"), ((k - 1) * (n - 1)).alias("df_error"))


def design_matrix(df: DataFrame, factors: dict[str, list], numbers: list[str] = ()) -> DataFrame:
    """Treatment contrasts: an intercept, one 0/1 column for each level of a factor but the first, and the numbers as they are."""
    columns = {"intercept": F.lit(1.0)}
    for name, levels in factors.items():
        columns |= {f"{name}_{level}": F.when(F.col(name).isin(*levels), (F.col(name) == level).cast("double")) for level in levels[1:]}
    return df.withColumns(columns | {n: clean(F.col(n)) for n in numbers})


def linear_model(df: DataFrame, terms: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """Least squares of `y` on the columns `terms` per group: `term`, `coefficient`, `se`, `t`. Terms that depend on those before them get null.

    One aggregation makes the sums of products, a row of numbers per group; only these are solved.
    """
    by = by or []
    columns = [clean(F.col(c)) for c in (*terms, y)]
    size = len(terms)
    whole = df.where(F.forall(F.array(*columns), lambda c: c.isNotNull()))
    places = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    sums = whole.groupBy(*by).agg(F.count("*").alias("_n"), F.array(*[F.sum(columns[i] * columns[j]) for i, j in places]).alias("_s"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, n, s in zip(pdf[by].itertuples(index=False, name=None) if by else [()] * len(pdf), pdf["_n"], pdf["_s"]):
                gram = np.zeros((size + 1, size + 1))
                for (i, j), v in zip(places, s):
                    gram[i, j] = gram[j, i] = v
                scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
                unit = gram / scale / scale[:, None]
                used: list[int] = []
                for k in range(size):  # a term is kept if enough of it is left beside those before it
                    rest = unit[k, k] - (unit[k, used] @ np.linalg.solve(unit[np.ix_(used, used)], unit[used, k]) if used else 0.0)
                    if rest > 1e-10:
                        used.append(k)
                inverse = np.linalg.inv(unit[np.ix_(used, used)])
                b = inverse @ unit[used, size]
                left = max(unit[size, size] - b @ unit[used, size], 0.0)
                for k, term in enumerate(terms):
                    if k in used:
                        at = used.index(k)
                        value = b[at] * scale[size] / scale[k]
                        se = math.sqrt(left * inverse[at, at] / (n - len(used))) * scale[size] / scale[k] if n > len(used) else None
                        rows.append((*key, term, value, se, value / se if se else None))
                    else:
                        rows.append((*key, term, None, None, None))
            yield pd.DataFrame(rows, columns=[*by, "term", "coefficient", "se", "t"])

    kinds = dict(df.dtypes)
    return sums.mapInPandas(solve, ", ".join([*[f"{c} {kinds[c]}" for c in by], "term string, coefficient double, se double, t double"]))


def differential_abundance(counts: DataFrame, cluster: str, condition: Column, successes: str, trials: str) -> DataFrame:
    """Quasi-binomial comparison of two conditions per cluster over samples (one row each): the log odds ratio, the dispersion (at least 1), its standard error and z.

    With one two-level covariate the likelihood is greatest at the pooled shares, so no iteration is needed.
    """
    rows = counts.where(condition.isNotNull() & (F.col(trials) > 0)).withColumn("_c", condition.cast("int"))
    pooled = rows.groupBy(cluster, "_c").agg(F.sum(successes).alias("_s"), F.sum(trials).alias("_t")).withColumn("_p", F.col("_s") / F.col("_t"))
    off = F.col(successes) - F.col(trials) * F.col("_p")
    fit = join_groups(rows, pooled, [cluster, "_c"]).groupBy(cluster).agg(F.sum(ratio(off * off, F.col(trials) * F.col("_p") * (1 - F.col("_p")))).alias("_x"), F.count("*").alias("samples"))
    pick = lambda c, k: F.max(F.when(F.col("_c") == k, F.col(c)))
    two = pooled.groupBy(cluster).agg(*[pick(c, k).alias(f"{c}{k}") for c in ("_p", "_t") for k in (0, 1)])
    logit = lambda p: F.log(ratio(p, 1 - p))
    spread = F.greatest(F.lit(1.0), ratio(F.col("_x"), F.col("samples") - 2))
    se = F.sqrt(spread * sum(ratio(F.lit(1.0), F.col(f"_t{k}") * F.col(f"_p{k}") * (1 - F.col(f"_p{k}"))) for k in (0, 1)))
    out = join_groups(two, fit, [cluster]).withColumns({"log_odds": logit(F.col("_p1")) - logit(F.col("_p0")), "dispersion": spread, "se": se})
    return out.select(cluster, "samples", "log_odds", "dispersion", "se", ratio(F.col("log_odds"), F.col("se")).alias("z"))


def to_pooled(df: DataFrame, batch: str, channel: str) -> DataFrame:
    """Each batch against all rows: Kolmogorov-Smirnov D and the area between the two distributions. Every row is counted once per batch and value."""
    x = clean(F.col(channel))
    own = df.where(x.isNotNull()).groupBy(batch, x.alias("_x")).agg(F.count("*").alias("_k"))
    every = ordered.cumulative(own.groupBy("_x").agg(F.sum("_k").alias("_a")), [], "_x", ["_a"]).select("_x", "_a", "cum__a")
    each = ordered.cumulative(own, [batch], "_x", ["_k"])
    sizes = own.groupBy(batch).agg(F.sum("_k").alias("_nb"))
    joined = join_groups(each.join(every, "_x"), sizes, [batch]).crossJoin(F.broadcast(own.agg(F.sum("_k").alias("_n"))))  # one row
    at = F.abs(F.col("cum__k") / F.col("_nb") - F.col("cum__a") / F.col("_n"))
    below = F.abs((F.col("cum__k") - F.col("_k")) / F.col("_nb") - (F.col("cum__a") - F.col("_a")) / F.col("_n"))
    return joined.groupBy(batch).agg(F.max(F.greatest(at, below)).alias("d"), F.max("_nb").alias("n"))


def ranked_rules(summary: DataFrame, by: str, rules: dict[str, dict[str, Column]]) -> DataFrame:
    """The rule that fits each row of a summary best: the share of a rule's conditions that hold; ties go to the first name. `by`, `rule`, `score`; none if nothing holds."""
    scores = [F.struct(sum((F.coalesce(c, F.lit(False)).cast("int") for c in parts.values()), F.lit(0)).cast("double").alias("n"), F.lit(len(parts)).alias("of"), F.lit(name).alias("rule")) for name, parts in sorted(rules.items())]
    rows = summary.select(by, F.inline(F.array(*scores))).withColumn("score", F.col("n") / F.col("of")).where("score > 0")
    best = Window.partitionBy(by).orderBy(F.desc("score"), "rule")
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(by, "rule", "score")
