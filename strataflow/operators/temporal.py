"""Time courses of events: bins, smoothing, pauses, drift, rates, overlapping bins, control rules, hash chains."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from strataflow.common import clean, cut, join_groups
from strataflow.operators import joins, ordered
from strataflow.operators.statistics import ratio


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def bins(df: DataFrame, by: list[str], ts: str, value: str, width: float, least: int = 10) -> DataFrame:
    """Median, mean and count per time bin (`bin` from the epoch); null statistics in bins of fewer than `least` values."""
    x = clean(F.col(value))
    rows = df.where(F.col(ts).isNotNull()).select(*by, F.floor(seconds(ts) / width).alias("bin"), x.alias("_x"))
    means = rows.groupBy(*by, "bin").agg(F.avg("_x").alias("mean"))
    own = join_groups(means, ordered.quantiles(rows, [*by, "bin"], {"x": F.col("_x")}, [0.5]), [*by, "bin"]).select(*by, "bin", F.col("n_x").alias("n"), F.col("q_x")[0].alias("median"), "mean")
    return own.select(*by, "bin", "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("median", "mean")])


def smoothed(binned: DataFrame, by: list[str], value: str, half: int) -> DataFrame:
    """Centred moving average over the bins at most `half` away by their index; empty and missing bins add nothing. Runs on bins, which are few per group."""
    near = Window.partitionBy(*by).orderBy("bin").rangeBetween(-half, half)
    return binned.withColumn("smooth", F.when(F.col(value).isNotNull(), F.avg(value).over(near)))


def box_smoothed(binned: DataFrame, by: list[str], value: str, bandwidth: int = 50) -> DataFrame:
    """Box kernel of width `bandwidth` over the bins' index: the mean of the bins at most half of it away, also where the bin itself has no value."""
    near = Window.partitionBy(*by).orderBy("bin").rangeBetween(-(bandwidth // 2), bandwidth // 2)
    return binned.withColumn("smooth", F.avg(value).over(near))


def running_median(binned: DataFrame, by: list[str], value: str, half: int) -> DataFrame:
    """Running median of odd width 2 * half + 1 by the bins' index.

    Towards the ends of a group the window shrinks so that it stays centred; its first and last bin follow Tukey's
    rule: the median of the bin itself, its neighbour's median s1 and 3 s1 - 2 s2.
    """
    group = Window.partitionBy(*by)
    order = group.orderBy("bin")
    rows = binned.withColumns({"_first": F.min("bin").over(group), "_last": F.max("bin").over(group), "_near": F.collect_list(F.struct("bin", value)).over(order.rangeBetween(-half, half))})  # at most 2 * half + 1 bins
    reach = F.least(F.lit(half), F.col("bin") - F.col("_first"), F.col("_last") - F.col("bin"))
    inside = F.filter("_near", lambda n: (F.abs(n["bin"] - F.col("bin")) <= F.col("_reach")) & n[value].isNotNull())
    values = F.array_sort(F.transform(inside, lambda n: n[value]))
    rows = rows.withColumn("_reach", reach).withColumn("_v", values)
    middle = (F.get("_v", F.floor((F.size("_v") - 1) / 2).cast("int")) + F.get("_v", F.floor(F.size("_v") / 2).cast("int"))) / 2
    rows = rows.withColumn("_m", middle)

    def end(step) -> Column:
        one, two = step("_m", 1).over(order), step("_m", 2).over(order)
        three = F.array_sort(F.array(F.col(value), one, 3 * one - 2 * two))
        return F.when(F.col(value).isNotNull() & one.isNotNull() & two.isNotNull(), three[1]).otherwise(F.col("_m"))

    out = F.when(F.col("_first") == F.col("_last"), F.col("_m")).when(F.col("bin") == F.col("_first"), end(F.lead)).when(F.col("bin") == F.col("_last"), end(F.lag)).otherwise(F.col("_m"))
    return rows.withColumn("running_median", out).drop("_first", "_last", "_near", "_reach", "_v", "_m")


def pauses(df: DataFrame, by: list[str], ts: str, least: float = 2.0, times: float = 50.0) -> DataFrame:
    """The longest gap of each group that is at least max(`least` seconds, `times` the median gap) and away from the outer tenths."""
    gaps = ordered.gaps(df.withColumn("_at", seconds(ts)), by, "_at")
    typical = ordered.quantiles(gaps, by, {"gap": F.col("gap")}, [0.5]).select(*by, F.col("q_gap")[0].alias("typical"))
    ends = join_groups(gaps.groupBy(*by).agg(F.min("start").alias("t0"), F.max("end").alias("t1")), typical, by)
    tenth = (F.col("t1") - F.col("t0")) / 10
    kept = join_groups(gaps, ends, by).where((F.col("gap") >= F.greatest(F.lit(least), times * F.col("typical"))) & (F.col("start") >= F.col("t0") + tenth) & (F.col("end") <= F.col("t1") - tenth))
    best = kept.groupBy(*by).agg(F.max_by(F.struct("start", "end", "gap"), F.struct("gap", -F.col("start"))).alias("g"))
    return best.select(*by, "g.start", "g.end", "g.gap")


def longest_gap(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    gaps = ordered.gaps(df.withColumn("_at", seconds(ts)), by, "_at")
    typical = ordered.quantiles(gaps, by, {"gap": F.col("gap")}, [0.5]).select(*by, F.col("q_gap")[0].alias("typical"))
    return join_groups(gaps.groupBy(*by).agg(F.max("gap").alias("gap")), typical, by)


def drift(df: DataFrame, by: list[str], ts: str, channels: list[str], parts: int = 20) -> DataFrame:
    """Median of each channel in `parts` equal time parts of each group."""
    at = seconds(ts)
    ends = df.where(F.col(ts).isNotNull()).groupBy(*by).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    part = F.least(F.lit(parts - 1), F.floor(F.try_divide(at - F.col("_a"), F.col("_b") - F.col("_a")) * parts)).cast("int")
    rows = join_groups(df.where(F.col(ts).isNotNull()), ends, by).where("_b > _a")
    wide = ordered.quantiles(rows.withColumn("part", part), [*by, "part"], {c: clean(F.col(c)) for c in channels}, [0.5])
    return wide.select(*by, "part", F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"q_{c}")[0].alias("median")) for c in channels])))


def theil_sen(medians: DataFrame, by: list[str]) -> DataFrame:
    """Median of the pairwise slopes of the parts' medians; groups have as many rows as parts."""
    a, b = medians.alias("a"), medians.alias("b")
    pairs = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col("a.part") < F.col("b.part")])
    slope = (F.col("b.median") - F.col("a.median")) / (F.col("b.part") - F.col("a.part"))
    return pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(F.percentile(slope, F.lit(0.5)).alias("slope"))


def rates(df: DataFrame, by: list[str], ts: str, width: float) -> DataFrame:
    """Events per time slice and the slice's robust score against its group (median and 1.4826 MAD)."""
    slices = df.where(F.col(ts).isNotNull()).groupBy(*by, F.floor(seconds(ts) / width).alias("slice")).count()
    middle = slices.groupBy(*by).agg(F.percentile("count", F.lit(0.5)).alias("m"))
    away = join_groups(slices, middle, by)
    spread = away.groupBy(*by).agg((1.4826 * F.percentile(F.abs(F.col("count") - F.col("m")), F.lit(0.5))).alias("s"))
    return join_groups(away, spread, by).select(*by, "slice", "count", ratio(F.col("count") - F.col("m"), F.col("s")).alias("score"))


def overlapping_bins(df: DataFrame, by: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Half-overlapping bins of `size` consecutive rows per group: count and median. Rows are numbered by buckets of times first, so no window holds a group."""
    half = size // 2
    numbered = numbered_rows(df, by, order)
    at = F.floor(F.col("row") / half)
    rows = numbered.select(*by, value, F.explode(F.when(at > 0, F.array(at, at - 1)).otherwise(F.array(at))).alias("bin"))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.percentile(clean(F.col(value)), F.lit(0.5)).alias("median"))  # `size` rows each


def numbered_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`row` from 0 in the order of `order` (its first column a time, null first) inside each group. Buckets of times are numbered apart, so no window holds a group."""
    parts = ordered.bucketed(df.withColumn("_at", seconds(order[0])), by, "_at").withColumnRenamed("bucket", "_slice")
    counts = parts.groupBy(*by, "_slice").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_slice", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    numbered = join_groups(parts.withColumn("_n", F.row_number().over(inside)), offsets, [*by, "_slice"])
    return numbered.withColumn("row", F.col("_offset") + F.col("_n") - 1).drop("_at", "_slice", "_n", "_offset")


def control_rules(runs: DataFrame, by: list[str], order: str, value: str, baseline: int = 20) -> DataFrame:
    """Westgard rules over a series of runs (one row per run): score against the first `baseline` runs, and the first rule that fires.

    1-3s, 2-2s, R-4s, 4-1s and 10x reject; 1-2s warns.
    """
    series = Window.partitionBy(*by).orderBy(order)
    first = runs.withColumn("_k", F.row_number().over(series)).where(F.col("_k") <= baseline)
    base = first.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    scored = join_groups(runs, base, by).withColumn("z", ratio(F.col(value) - F.col("_m"), F.col("_s")))
    z, back = F.col("z"), lambda k: F.lag("z", k).over(series)
    same = lambda n, t: F.coalesce(_all_of([f(back(k) if k else z) for k in range(n) for f in [lambda x: x > t]]) | _all_of([f(back(k) if k else z) for k in range(n) for f in [lambda x: x < -t]]), F.lit(False))
    opposite = F.coalesce(((z > 2) & (back(1) < -2)) | ((z < -2) & (back(1) > 2)), F.lit(False))
    rule = (
        F.when(F.abs(z) > 3, "1-3s")
        .when(same(2, 2), "2-2s")
        .when(opposite & (F.abs(z - back(1)) > 4), "R-4s")
        .when(same(4, 1), "4-1s")
        .when(same(10, 0), "10x")
        .when(F.abs(z) > 2, "1-2s")
    )
    return scored.select(*by, order, value, "z", rule.alias("rule"))


def _all_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


#: Entries of a log that are chained one by one; the blocks' ends are chained in turn.
LINKS = 1000


def chained(rows: DataFrame, by: list[str], order: list[str], content: Column) -> DataFrame:
    """A tamper-evident log: each entry's `link` hashes the link before it and the entry's content; a group's first link hashes ''.

    A chain is sequential, so it is cut into blocks of LINKS entries (`block`). Inside a block each link hashes
    the one before; a block begins with the `head` of the blocks before it, which chains the blocks' own digests. So
    every link depends on all entries of its group before it, and no task walks more than a block or a group's heads.
    """
    numbered = numbered_rows(rows.withColumn("_own", F.sha2(content, 256)), by, order).withColumn("block", F.floor(F.col("row") / LINKS))
    columns = [c for c in numbered.columns if c not in by and c not in ("row", "block")]
    blocks = numbered.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("row", *columns))).alias("_e"))  # at most LINKS entries
    own = F.transform("_e", lambda e: e["_own"])
    digests = blocks.select(*by, "block", F.sha2(F.array_join(own, ""), 256).alias("_digest"))
    series = digests.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("block", "_digest"))).alias("_d"))  # one digest for LINKS entries
    ends = series.select(*by, "_d", _links(F.lit(""), F.transform("_d", lambda d: d["_digest"])).alias("_h"))
    heads = ends.select(*by, F.inline(F.transform("_d", lambda d, k: F.struct(d["block"].alias("block"), F.coalesce(F.get("_h", k - 1), F.lit("")).alias("head")))))
    linked = join_groups(blocks, heads, [*by, "block"]).withColumn("_l", _links(F.col("head"), own))
    entries = linked.select(*by, "block", F.inline(F.transform("_e", lambda e, k: F.struct(*[e[c].alias(c) for c in ("row", *columns)], F.get("_l", k).alias("link")))))
    return entries.drop("_own")


@F.pandas_udf(ArrayType(StringType()))
def _links(start: pd.Series, contents: pd.Series) -> pd.Series:
    """Running hashes: each of the one before it and the next content."""

    def run(link: str, parts) -> list[str]:
        out = []
        for part in parts:
            link = hashlib.sha256((link + part).encode()).hexdigest()
            out.append(link)
        return out

    return pd.Series([run(a, b) for a, b in zip(start, contents)])


def verified(log: DataFrame, by: list[str], order: list[str], content: Column) -> DataFrame:
    """Walk a stored log (with its `link`) again: per group its `entries`, the number of `broken` links and the `first_broken` row, null if none."""
    again = chained(log.withColumnRenamed("link", "_stored").drop("row", "block"), by, order, content)
    wrong = ~F.col("link").eqNullSafe(F.col("_stored"))
    return again.groupBy(*by).agg(F.count("*").alias("entries"), F.count_if(wrong).alias("broken"), F.min(F.when(wrong, F.col("row"))).alias("first_broken"))


def auc(binned: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """Area under the bins' values by the trapezoid rule over existing bins."""
    series = Window.partitionBy(*by).orderBy("bin")
    kept = binned.where(F.col(value).isNotNull())
    step = (F.col("bin") - F.lag("bin").over(series)) * width * (F.col(value) + F.lag(value).over(series)) / 2
    return kept.withColumn("_a", step).groupBy(*by).agg(F.sum("_a").alias("area"))


def response(binned: DataFrame, by: list[str], value: str, before: int) -> DataFrame:
    """Baseline (mean of the first `before` bins), peak, its bin and height over the baseline, and the first bin at half of that height and the share of later bins above it."""
    series = Window.partitionBy(*by).orderBy("bin")
    rows = binned.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(series))
    after = F.when(F.col("_k") > before, F.col(value))
    found = rows.groupBy(*by).agg(
        F.avg(F.when(F.col("_k") <= before, F.col(value))).alias("baseline"),
        F.max(after).alias("peak"),
        F.max_by(F.when(F.col("_k") > before, F.col("bin")), F.when(F.col("_k") > before, F.struct(F.col(value), -F.col("bin")))).alias("peak_bin"),
    ).withColumn("rise", F.col("peak") - F.col("baseline"))
    high = after >= F.col("baseline") + F.col("rise") / 2
    halves = join_groups(rows, found, by).groupBy(*by).agg(F.min(F.when(high, F.col("bin"))).alias("half_bin"), (F.count_if(high) / F.nullif(F.count(after), F.lit(0))).alias("responding"))
    return join_groups(found, halves, by)


def aligned(binned: DataFrame, by: list[str], origin: DataFrame, at: str) -> DataFrame:
    """Curves on a common clock: `offset` is each bin's distance from its group's origin (column `at`); groups without one are left out."""
    return join_groups(binned, origin.where(F.col(at).isNotNull()), by, "inner").withColumn("offset", F.col("bin") - F.col(at)).drop(at)


def fold_change(parts: DataFrame, by: list[str], last: int = 19) -> DataFrame:
    """Last tenth over first tenth of a drift's parts (see `drift`): the mean median of each."""
    edge = max(1, (last + 1) // 10)
    mean = lambda hit: F.avg(F.when(hit, F.col("median")))
    return parts.groupBy(*by).agg(ratio(mean(F.col("part") > last - edge), mean(F.col("part") < edge)).alias("fold"))


def corrected(df: DataFrame, by: list[str], ts: str, value: str, knots: DataFrame, knot_ts: str, factor: str) -> DataFrame:
    """Each row's value times a factor interpolated in time between the knots around it, clamped at both ends.

    Every knot knows the one after it, so one as-of join finds both knots of a row; rows before the first knot take that one's factor.
    """
    at, f = seconds(knot_ts), F.col(factor).cast("double")
    order = Window.partitionBy(*by).orderBy(knot_ts)  # one row per knot
    own = knots.where(F.col(knot_ts).isNotNull()).select(*by, F.col(knot_ts).alias(ts), F.struct(at.alias("t"), f.alias("f"), F.lead(at).over(order).alias("t2"), F.lead(f).over(order).alias("f2")).alias("_k"))
    first = own.groupBy(*by).agg(F.min_by("_k", ts).alias("_first"))
    rows = join_groups(joins.as_of(df, own, by, ts, "_k"), first, by, "inner")
    share = F.try_divide(seconds(ts) - F.col("_k.t"), F.col("_k.t2") - F.col("_k.t"))
    found = F.when(F.col("_k").isNull(), F.col("_first.f")).when(F.col("_k.t2").isNull(), F.col("_k.f")).otherwise(F.col("_k.f") + share * (F.col("_k.f2") - F.col("_k.f")))
    return rows.withColumn("factor", found).withColumn("corrected", F.col(value) * found).drop("_k", "_first")
