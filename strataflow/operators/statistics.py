"""Statistics of channels and populations as aggregates.

Values that are null, NaN or infinite are dropped first, as the statistics of a channel are those of its
finite values. Quantiles are exact with linear interpolation. Groups without values give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.common import clean, cut, join_groups
from strataflow.operators import ordered

Z95 = 1.959963984540054

def ratio(a: Column, b: Column, times: float = 1.0) -> Column:
    return F.when(b != 0, F.lit(times) * a / b)


#: Statistic id -> aggregate over a cleaned channel.
MOMENTS = {
    "count": lambda x: F.count(x),
    "mean": lambda x: F.avg(x),
    "geomean": lambda x: F.exp(F.avg(F.when(x > 0, F.log(F.when(x > 0, x))))),
    "excluded": lambda x: F.count_if(x <= 0),
    "sd": lambda x: F.stddev_samp(x),
    "cv": lambda x: ratio(F.stddev_samp(x), F.abs(F.avg(x)), 100.0),
    "min": lambda x: F.min(x),
    "max": lambda x: F.max(x),
}
LOW, MIDDLE, HIGH = 0.1587, 0.5, 0.8413
#: Statistic id -> expression over the array of the quantiles LOW, MIDDLE and HIGH.
QUANTILES = {
    "median": lambda q: q[1],
    "rsd": lambda q: (q[2] - q[0]) / 2,
    "rcv": lambda q: ratio((q[2] - q[0]) / 2, F.abs(q[1]), 100.0),
    "robust_sd": lambda q: q[2] - q[1],
}


def percentiles(df: DataFrame, by: list[str], channel: str, percents: list[float]) -> DataFrame:
    """Exact percentiles per group as columns p<percent>; see `ordered.quantiles` for how groups of any size are handled."""
    q = ordered.quantiles(df, by, {"x": clean(F.col(channel))}, [p / 100 for p in percents])
    return q.select(*by, *[F.col("q_x")[k].alias(f"p{p:g}") for k, p in enumerate(percents)])


def positive(x: Column, threshold: float) -> Column:
    """Percent at or above a threshold."""
    return ratio(F.count_if(x >= threshold), F.count(x), 100.0)


def describe(df: DataFrame, by: list[str], channels: list[str], stats: list[str]) -> DataFrame:
    """One row per group and channel with the statistics asked for: moments and sketches in one scan, the exact quantiles in a second."""
    moments = [MOMENTS[s](clean(F.col(c))).alias(f"{c}__{s}") for c in channels for s in stats if s in MOMENTS]
    if any(s in QUANTILES for s in stats):
        wide = ordered.quantiles(df, by, {c: clean(F.col(c)) for c in channels}, [LOW, MIDDLE, HIGH], beside=moments)
    else:
        wide = df.groupBy(*by).agg(F.count("*").alias("_all"), *moments)
    value = lambda c, s: (F.col(f"{c}__{s}") if s in MOMENTS else QUANTILES[s](F.col(f"q_{c}"))).cast("double").alias(s)
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), *[value(c, s) for s in stats]) for c in channels])))


def mad(df: DataFrame, by: list[str], channel: str, scale: float = 1.0) -> DataFrame:
    """Median absolute deviation per group: medians first, then the medians of the deviations from them."""
    x = clean(F.col(channel))
    middle = cut(ordered.quantiles(df, by, {"x": x}, [0.5]).select(*by, F.col("q_x")[0].alias("_m")))  # a row per group
    away = ordered.quantiles(join_groups(df, middle, by), by, {"d": F.abs(x - F.col("_m"))}, [0.5])
    return away.select(*by, (F.col("q_d")[0] * scale).alias("mad"))


def mode(df: DataFrame, by: list[str], channel: str, bins: int = 256) -> DataFrame:
    """Centre of the fullest of `bins` bins between the 0.5th and 99.5th percentile; the lowest wins ties."""
    x = clean(F.col(channel))
    ends = cut(ordered.quantiles(df, by, {"x": x}, [0.005, 0.995]).select(*by, F.col("q_x")[0].alias("low"), F.col("q_x")[1].alias("high")))  # a row per group
    at = F.floor(F.try_divide(x - F.col("low"), F.col("high") - F.col("low")) * bins)
    counted = (
        join_groups(df, ends, by)
        .where(x.between(F.col("low"), F.col("high")) & (F.col("high") > F.col("low")))
        .groupBy(*by, "low", "high", F.least(at, F.lit(bins - 1)).alias("bin"))
        .count()
    )
    best = counted.groupBy(*by, "low", "high").agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("bin"))
    return best.select(*by, (F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins).alias("mode"))


def stain_index(df: DataFrame, by: list[str], channel: str, positive: Column) -> DataFrame:
    """(median of the positive - median of the negative) / (2 rSD of the negative)."""
    x = clean(F.col(channel))
    q = ordered.quantiles(df, by, {"p": F.when(positive, x), "n": F.when(~positive, x)}, [LOW, MIDDLE, HIGH])
    return q.select(*by, ratio(F.col("q_p")[1] - F.col("q_n")[1], 2 * QUANTILES["rsd"](F.col("q_n"))).alias("stain_index"))


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    p = successes / trials
    middle, half = p + z * z / (2 * trials), z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    base = 1 + z * z / trials
    return F.when(trials > 0, F.greatest(F.lit(0.0), (middle - half) / base)), F.when(trials > 0, F.least(F.lit(1.0), (middle + half) / base))


def detection_limits(df: DataFrame, level: str, value: str, blank: Column) -> DataFrame:
    """Limit of blank (mean + 1.645 SD of blanks) and of detection (LoB + 1.645 pooled SD of the low levels), one row."""
    x = clean(F.col(value))
    blanks = df.where(blank).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    low = df.where(~blank).groupBy(level).agg(F.count(x).alias("n"), F.var_samp(x).alias("v")).where("n > 1")
    pooled = low.agg(F.sqrt(F.try_divide(F.sum((F.col("n") - 1) * F.col("v")), F.sum(F.col("n") - 1))).alias("pooled"))
    lob = F.col("m") + 1.645 * F.col("s")
    return blanks.join(pooled).select(lob.alias("lob"), (lob + 1.645 * F.col("pooled")).alias("lod"))


def rank_limits(df: DataFrame, value: str, blank: Column, share: float = 0.95) -> DataFrame:
    """Limit of blank by ranks: the value at rank share * n + 0.5 of the blanks, between its neighbours, and the number of blanks. One row.

    Interpolation between ranks is that of the quantile at (rank - 1) / (n - 1), so the limit comes from the exact quantiles of the two ranks.
    """
    x = clean(F.col(value))
    kept = df.where(blank & x.isNotNull()).select(x.alias("_x"))
    counted = kept.groupBy("_x").agg(F.count("*").alias("_n"))
    placed = ordered.cumulative(counted, [], "_x", ["_n"]).crossJoin(F.broadcast(counted.agg(F.sum("_n").alias("_all"))))  # one row
    rank = F.col("_all") * share + 0.5
    at = lambda r: F.min(F.when(F.col("cum__n") >= F.least(r, F.col("_all")), F.col("_x")))
    low = placed.agg(at(F.floor(rank)).alias("a"), at(F.ceil(rank)).alias("b"), F.max("_all").alias("blanks"), F.max(rank - F.floor(rank)).alias("f"))
    return low.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("lob"), "blanks")


def quantification_limit(df: DataFrame, level: str, value: str, cv: float = 20.0) -> DataFrame:
    """The smallest level whose readings scatter by at most `cv` percent of their mean, at it and at every higher level; null if none. One row."""
    x = clean(F.col(value))
    own = df.groupBy(level).agg(F.avg(x).alias("m"), ratio(100 * F.stddev_samp(x), F.abs(F.avg(x))).alias("cv")).where(F.col(level).isNotNull())
    bad = own.agg(F.max(F.when(~F.coalesce(F.col("cv") <= cv, F.lit(False)), F.col(level))).alias("_bad"))  # the highest level that fails
    return own.crossJoin(F.broadcast(bad)).agg(F.min(F.when(F.col("_bad").isNull() | (F.col(level) > F.col("_bad")), F.col(level))).alias("loq"))


def events_needed(cv: Column) -> Column:
    """Events that a count needs for a counting error of `cv` percent."""
    return F.ceil(F.pow(100.0 / cv, 2))


def filled_histogram(df: DataFrame, by: list[str], channel: str, low: float, high: float, bins: int, half: int = 0) -> DataFrame:
    """A histogram with a row for every bin, empty ones too, and its centred moving average over 2 * half + 1 bins (`smooth`), fewer at the ends."""
    counts = histogram(df, by, channel, low, high, bins)
    every = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")) if by else df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    near = Window.partitionBy(*by).orderBy("bin").rowsBetween(-half, half)  # `bins` rows a group
    filled = join_groups(every, counts, [*by, "bin"]).withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return filled.withColumn("smooth", F.avg("count").over(near))


def bandwidths(df: DataFrame, by: list[str], channel: str) -> DataFrame:
    """Kernel density bandwidths per group: Silverman's and Scott's rules and that of R's nrd0."""
    x = clean(F.col(channel))
    q = ordered.quantiles(df, by, {"x": x}, [0.25, 0.75], beside=[F.stddev_samp(x).alias("sd"), F.count(x).alias("n")])
    spread = ratio(F.col("q_x")[1] - F.col("q_x")[0], F.lit(1.34))
    least = F.when((spread > 0) & (spread < F.col("sd")), spread).otherwise(F.col("sd"))
    scale = F.pow(F.col("n").cast("double"), F.lit(-0.2))
    first = F.col("q_x")[0]
    nrd0 = F.when(least > 0, least).when(first != 0, F.abs(first)).otherwise(1.0)
    return q.select(*by, (0.9 * least * scale).alias("silverman"), (1.06 * F.col("sd") * scale).alias("scott"), (0.9 * nrd0 * scale).alias("nrd0"))


def event_densities(df: DataFrame, x: str, y: str, x_range: tuple, y_range: tuple, bins: int) -> DataFrame:
    """The events with the count of their cell of a grid (`density`); events without both values get null. The cells are few rows, the events are not reordered."""
    at = lambda c, ends: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((clean(F.col(c)) - ends[0]) / (ends[1] - ends[0]) * bins))).cast("int")
    cells = histogram2d(df, x, y, x_range, y_range, bins).select(F.col("x_bin").alias("_xb"), F.col("y_bin").alias("_yb"), F.col("count").alias("density"))
    return df.withColumns({"_xb": F.when(clean(F.col(x)).isNotNull(), at(x, x_range)), "_yb": F.when(clean(F.col(y)).isNotNull(), at(y, y_range))}).join(F.broadcast(cells), ["_xb", "_yb"], "left").drop("_xb", "_yb")  # bins * bins rows


def density_peaks(filled: DataFrame, by: list[str], floor: float = 0.05) -> DataFrame:
    """Local maxima of a filled histogram's `smooth` of at least `floor` of the highest, ranked by height (ties by bin). A plateau counts once, at its first bin."""
    order, group = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    rows = filled.withColumns({"_new": (F.col("smooth") != F.coalesce(F.lag("smooth").over(order), F.lit(-1.0))).cast("int"), "_top": F.max("smooth").over(group)})
    steps = rows.withColumn("_p", F.sum("_new").over(order)).groupBy(*by, "_p").agg(F.min("bin").alias("bin"), F.max("smooth").alias("height"), F.max("_top").alias("_top"))
    walk = Window.partitionBy(*by).orderBy("_p")
    peak = (F.col("height") > F.coalesce(F.lag("height").over(walk), F.lit(-1.0))) & (F.col("height") > F.coalesce(F.lead("height").over(walk), F.lit(-1.0))) & (F.col("height") >= floor * F.col("_top"))
    return steps.withColumn("_peak", peak).where("_peak AND height > 0").select(*by, "bin", "height", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("height"), "bin")).alias("rank"))


def histogram(df: DataFrame, by: list[str], channel: str, low: float, high: float, bins: int, pile: bool = True) -> DataFrame:
    """Counts per bin; with `pile` values off the scale go to the end bins, else they are dropped."""
    x = clean(F.col(channel))
    at = F.floor((x - low) / (high - low) * bins)
    df = df.where(x.isNotNull())
    if pile:
        at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), at))
    else:
        df = df.where((at >= 0) & (at < bins))
    return df.groupBy(*by, at.cast("int").alias("bin")).count()


def histogram2d(df: DataFrame, x: str, y: str, x_range: tuple, y_range: tuple, bins: int) -> DataFrame:
    def at(c: str, ends: tuple) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((clean(F.col(c)) - ends[0]) / (ends[1] - ends[0]) * bins))).cast("int")

    return df.where(clean(F.col(x)).isNotNull() & clean(F.col(y)).isNotNull()).groupBy(at(x, x_range).alias("x_bin"), at(y, y_range).alias("y_bin")).count()


def density_levels(cells: DataFrame, fractions: list[float]) -> DataFrame:
    """Smallest cell count so that cells at least that full hold each fraction of the events. Cells are a bounded grid."""
    full = Window.orderBy(F.desc("count")).rangeBetween(Window.unboundedPreceding, 0)
    ranked = cells.select("count", (F.sum("count").over(full) / F.sum("count").over(Window.partitionBy())).alias("held"))
    return ranked.agg(*[F.max(F.when(F.col("held") >= f, F.col("count"))).alias(f"level_{int(f * 100)}") for f in fractions]).select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("fraction"), F.col(f"level_{int(f * 100)}").alias("level")) for f in fractions]))
    )
