"""Order-dependent sums without a window over a whole group.

Values are counted once per distinct value, put into buckets by approximate quantiles of their group and
summed in two steps: offsets over the buckets of a group, and a window inside each bucket. The number of
buckets follows the number of values, so a group of any size is spread over tasks of bounded size. Null is
a group like any other; values that are null, NaN or infinite have no rank and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.common import clean, cut, join_groups

#: Buckets of a group by approximate quantiles: STEP coarse ones of STEP fine ones each; they are parted further for more than TARGET values in one.
STEP = 8
BUCKETS = STEP * STEP
TARGET = 1_000_000
#: Ranks found by the sketch are off by a share of the group's size of 1 / ACCURACY at most; MARGIN such shares on either side bracket the exact value.
ACCURACY, MARGIN = 10_000, 3


def _place(value: Column, edge, low: int, high: int) -> Column:
    """Number of the sorted edges low..high - 1 that lie below the value, as a balanced tree of comparisons."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value <= edge(middle), _place(value, edge, low, middle)).otherwise(_place(value, edge, middle + 1, high))


def _part(value: Column, low: Column, high: Column, parts: Column) -> Column:
    """Which of `parts` equal stretches between `low` and `high` holds the value."""
    share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
    return F.greatest(F.lit(0), F.least(parts - 1, F.floor(share * parts))).cast("long")


def bucketed(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """`rows` with `bucket`, increasing with `value` inside each group; equal values share one.

    The edges are approximate quantiles; between them buckets of groups with more than BUCKETS * TARGET rows are parted evenly.
    """
    x = F.col(value).cast("double")
    edges = rows.groupBy(*by).agg(F.percentile_approx(x, [k / BUCKETS for k in range(BUCKETS + 1)], 1000).alias("_edges"), F.ceil(F.count(value) / (BUCKETS * TARGET)).alias("_parts"))
    out = join_groups(rows, edges, by)  # one short array per group
    # Two small trees instead of one large one keep the generated code short enough to be compiled.
    out = out.withColumn("_coarse", _place(x, lambda k: F.col("_edges")[(k + 1) * STEP], 0, STEP - 1))
    out = out.withColumn("_fine", F.col("_coarse") * STEP + _place(x, lambda k: F.col("_edges")[F.col("_coarse") * STEP + k + 1], 0, STEP - 1))
    part = F.when(F.col("_parts") > 1, _part(x, F.col("_edges")[F.col("_fine")], F.col("_edges")[F.col("_fine") + 1], F.col("_parts"))).otherwise(0)
    bucket = F.when(x.isNull(), -1).otherwise(F.col("_fine") * F.col("_parts") + part)  # nulls lie before all values
    return out.withColumn("bucket", bucket).drop("_edges", "_parts", "_coarse", "_fine")


def cumulative(counted: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """Adds, for each column of `sums`, `cum_<column>`: its sum up to and including the row's value; and `next_value`.

    `counted` has one row per group and value.
    """
    rows = bucketed(counted, by, value)
    totals = rows.groupBy(*by, "bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums], F.min(value).alias("_first"))
    over = Window.partitionBy(*by).orderBy("bucket")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "bucket", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums], F.lead("_first").over(over).alias("_next"))
    inside = Window.partitionBy(*by, "bucket").orderBy(value)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = join_groups(rows, offsets, [*by, "bucket"])
    return out.select(
        *counted.columns,
        *[(F.col(f"_o_{c}") + F.sum(c).over(running)).alias(f"cum_{c}") for c in sums],
        F.coalesce(F.lead(value).over(inside), F.col("_next")).alias("next_value"),
    )


def average_ranks(df: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """Per value and group its count `n`, the tie size `ties` over all groups and the average `rank` (from 1)."""
    own = df.where(clean(F.col(value)).isNotNull()).groupBy(*by, value, group).agg(F.count("*").alias("n"))
    counted = own.groupBy(*by, value).agg(F.sum("n").alias("ties"))
    ranked = cumulative(counted, by, value, ["ties"]).select(*by, value, "ties", (F.col("cum_ties") - (F.col("ties") - 1) / 2).alias("rank"))
    return join_groups(own, ranked, [*by, value])


def steps(df: DataFrame, by: list[str], value: str, control: Column, test: Column) -> DataFrame:
    """The two cumulative distributions of control and test rows at each distinct value: `c`, `t`, sizes `nc`, `nt`, and `next_value`."""
    kept = df.where(clean(F.col(value)).isNotNull() & (control | test))
    counted = kept.groupBy(*by, value).agg(F.count_if(control).alias("kc"), F.count_if(test).alias("kt"))
    sizes = counted.groupBy(*by).agg(F.sum("kc").alias("nc"), F.sum("kt").alias("nt"))
    rows = cumulative(counted, by, value, ["kc", "kt"])
    return join_groups(rows, sizes, by).select(*by, value, "next_value", (F.col("cum_kc") / F.col("nc")).alias("c"), (F.col("cum_kt") / F.col("nt")).alias("t"), "nc", "nt")


def gaps(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Each distinct time (seconds) of a group with the one before it: `start`, `end`, `gap`. Buckets of times are walked apart and joined by their ends."""
    times = bucketed(df.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("end")).distinct(), by, "end")
    lasts = times.groupBy(*by, "bucket").agg(F.max("end").alias("_last"))
    before = lasts.select(*by, "bucket", F.lag("_last").over(Window.partitionBy(*by).orderBy("bucket")).alias("_before"))
    inside = F.lag("end").over(Window.partitionBy(*by, "bucket").orderBy("end"))
    rows = join_groups(times, before, [*by, "bucket"]).select(*by, F.coalesce(inside, F.col("_before")).alias("start"), "end")
    return rows.where("start IS NOT NULL").withColumn("gap", F.col("end") - F.col("start"))


def quantiles(df: DataFrame, by: list[str], columns: dict[str, Column], probabilities: list[float], beside: list[Column] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: per group `n_<name>` and `q_<name>`, an array in the order of `probabilities`.

    Two scans. The first makes a mergeable sketch per group and column (and the aggregates `beside`); its error is
    bounded, so it brackets every wanted rank (or, in groups of few values, lies next to it). The second counts: values outside the brackets by the gap they lie in,
    those inside, a small share, one by one. Only these are ordered, in parts of bounded size. Null values are
    dropped; groups without values have n 0 and null.
    """
    wanted = sorted(set(probabilities))
    keys, names = [f"_by{k}" for k in range(len(by))], list(columns)
    values = [f"_v{k}" for k in range(len(names))]
    wide = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *[c.cast("double").alias(v) for c, v in zip(columns.values(), values)])
    step = MARGIN / ACCURACY
    ends = [min(max(q + s, 0.0), 1.0) for s in (-step, step) for q in wanted]  # the brackets' lower ends, then their upper ends
    sketched = [x for k, v in enumerate(values) for x in (F.count(v).alias(f"_n{k}"), F.percentile_approx(v, ends, ACCURACY).alias(f"_e{k}"))]
    # One row per group, kept, so that nothing of the first scan is done twice.
    if beside:
        sketches = df.select("*", *[F.col(c).alias(k) for c, k in zip(by, keys)], *[c.cast("double").alias(v) for c, v in zip(columns.values(), values)]).groupBy(*keys).agg(*sketched, *beside)
    else:
        sketches = wide.groupBy(*keys).agg(*sketched)
    sketches = cut(sketches)
    extra = [c for c in sketches.columns if c not in keys and not c.startswith(("_n", "_e"))]
    most = sketches.agg(F.max(F.greatest(*[F.col(f"_n{k}") for k in range(len(values))], F.lit(0)))).first()[0] or 0
    # A value's place: the number of brackets that begin at or below it, and the value itself if it lies inside one.
    at, own = len(wanted), [*keys, "_c"]
    flat = [F.get(f"_e{k}", i).alias(f"_e{k}_{i}") for k in range(len(values)) for i in range(2 * at)] if at <= 8 else [F.col(f"_e{k}") for k in range(len(values))]
    near = sketches.select(*keys, *[F.ceil(F.col(f"_n{k}") * (2 * MARGIN / ACCURACY) / TARGET).alias(f"_p{k}") for k in range(len(values))], *flat)
    rows, structs, places = join_groups(wide, near, keys), [], {}
    for k, v in enumerate(values):
        x = F.col(v)
        if at <= 8:
            low, high = ([F.col(f"_e{k}_{i + side}") for i in range(at)] for side in (0, at))
            begun = sum((F.when(x >= e, 1).otherwise(0) for e in low), F.lit(0))
            lower, upper = (F.coalesce(*[F.when(x >= e, y) for e, y in zip(reversed(low), reversed(ys))]) for ys in (low, high))
        else:
            edges = F.col(f"_e{k}")
            begun = F.size(F.filter(F.slice(edges, 1, at), lambda e: e <= x))  # noqa: B023
            lower, upper = F.get(edges, begun - 1), F.get(edges, F.when(begun > 0, begun + (at - 1)))
        places |= {f"_k{k}": F.when(x.isNotNull(), begun), f"_l{k}": lower, f"_u{k}": upper}
    rows = rows.withColumns(places)
    for k, v in enumerate(values):
        x, inside = F.col(v), F.coalesce(F.col(v) <= F.col(f"_u{k}"), F.lit(False))
        part = F.when(inside & (F.col(f"_p{k}") > 1), _part(x, F.col(f"_l{k}"), F.col(f"_u{k}"), F.col(f"_p{k}"))).otherwise(F.lit(0).cast("long"))
        structs.append(F.struct(F.lit(k).alias("_c"), F.col(f"_k{k}").alias("_k"), (~inside).alias("_gap"), part.alias("_p"), F.when(inside, x).alias("_x"), x.alias("_v")))
    counted = rows.select(*keys, F.inline(F.array(*structs))).where("_k IS NOT NULL").groupBy(*own, "_k", "_gap", "_p", "_x").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    group = Window.partitionBy(*own)
    order = ["_k", "_gap", "_p"]
    ranks = [x for q in wanted for x in (F.floor((F.col("_all") - 1) * q), F.ceil((F.col("_all") - 1) * q))]
    if most * at * 2 * MARGIN / ACCURACY <= TARGET:
        # What lies in the brackets of one group fits a task.
        walk = group.orderBy(*order, "_x").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumns({"_end": F.sum("_n").over(walk), "_all": F.sum("_n").over(group)})
    else:
        # The filter on the ends keeps both uses of `counted` alike, so that Spark makes it once.
        totals = counted.groupBy(*own, *order).agg(F.sum("_n").alias("_t"), F.min("_low").alias("_a"), F.max("_high").alias("_b")).where("_a <= _b")
        before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumns({"_o": F.coalesce(F.sum("_t").over(before), F.lit(0)), "_all": F.sum("_t").over(group)}).drop("_a", "_b")
        held = offsets.where(F.exists(F.array(*ranks), lambda r: (r >= F.col("_o")) & (r < F.col("_o") + F.col("_t"))))
        inside = Window.partitionBy(*own, *order).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
        placed = join_groups(counted, held, [*own, *order], "inner").withColumn("_end", F.col("_o") + F.sum("_n").over(inside))
    # In small groups a wanted rank may be the first or the last of a gap: these two values are known.
    first = F.col("_end") - F.col("_n")
    pick = lambda r: F.max(F.when((r >= first) & (r < F.col("_end")), F.when((r == first) | ~F.col("_gap"), F.col("_low")).when(r == F.col("_end") - 1, F.col("_high"))))
    picked = placed.groupBy(*own).agg(F.max("_all").alias("_all"), *[pick(r).alias(f"_r{k}") for k, r in enumerate(ranks)])
    share = lambda q: (F.col("_all") - 1) * q - F.floor((F.col("_all") - 1) * q)
    found = {q: F.col(f"_r{2 * k}") + (F.col(f"_r{2 * k + 1}") - F.col(f"_r{2 * k}")) * share(q) for k, q in enumerate(wanted)}
    if len(names) == 1:
        wide_q = picked.select(*keys, F.array(*[found[q] for q in probabilities]).alias(f"q_{names[0]}"))
    else:
        wide_q = picked.select(*own, F.array(*[found[q] for q in probabilities]).alias("_q")).groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == k, F.col("_q"))).alias(f"q_{name}") for k, name in enumerate(names)])
    if not keys:  # a single row, also when no value is there
        wide_q = wide_q.agg(*[F.max(f"q_{name}").alias(f"q_{name}") for name in names])
    out = join_groups(sketches, wide_q, keys)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *[x for k, name in enumerate(names) for x in (F.coalesce(F.col(f"_n{k}"), F.lit(0)).alias(f"n_{name}"), F.col(f"q_{name}"))], *extra)
