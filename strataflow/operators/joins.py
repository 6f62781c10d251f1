"""Joins of events with dimensions, earlier rows, intervals and other snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.common import bounded, join_groups
from strataflow.operators import ordered


def with_dimension(events: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join with one row per key; broadcast only when the dimension's estimated size is within the limit."""
    return events.join(bounded(dimension.dropDuplicates(on)), on, how)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each left row with the latest right `value` at or before its time (null without one, and for null times).

    Both sides are walked per group and bucket of times; buckets follow the number of rows. What a bucket begins
    with is carried over from the last one that has a value, so no group is ordered in one task.
    """
    tag = left.columns
    known = right.where(F.col(at).isNotNull()).select(*by, F.col(at), F.col(value).alias("_v"), F.lit(False).alias("_left"))
    rows = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(True)}).unionByName(known, allowMissingColumns=True)
    rows = ordered.bucketed(rows.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp"))), by, "_at").withColumnRenamed("bucket", "_slice")
    inside = Window.partitionBy(*by, "_slice").orderBy(F.col(at), F.col("_left").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*by, "_slice").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(at))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    out = join_groups(rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).where("_left"), carried, [*by, "_slice"])
    return out.select(*tag, F.coalesce("_in", "_before").alias(value))


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, seconds: int) -> DataFrame:
    """Points joined with the half-open spans that hold them, by equality of time buckets of `seconds`; a span lies in every bucket it touches."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    wide = spans.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    return points.withColumn("_b", bucket(at)).join(wide, [*by, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def matched(wanted: DataFrame, catalogue: DataFrame, name: str, keys: list[Column]) -> DataFrame:
    """Each wanted name with the first catalogue name that equals it under the first of `keys` (columns over `name`) that matches any."""
    out = wanted.select(F.col(name).alias("wanted"))
    tries = []
    for k, key in enumerate(keys):
        own = catalogue.select(key.alias("_k"), F.col(name).alias(f"_m{k}")).groupBy("_k").agg(F.min(f"_m{k}").alias(f"_m{k}"))
        theirs = wanted.select(F.col(name).alias("wanted"), key.alias("_k"))
        tries.append(theirs.join(own, "_k").groupBy("wanted").agg(F.min(f"_m{k}").alias(f"_m{k}")))
    for t in tries:
        out = out.join(t, "wanted", "left")
    return out.select("wanted", F.coalesce(*[F.col(f"_m{k}") for k in range(len(keys))]).alias("match"))


def differences(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots. Numbers within the relative tolerance are the same."""
    a, b = before.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_a")), after.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    joined = a.join(b, keys, "full_outer")
    kinds = dict(before.dtypes)
    changed = F.lit(False)
    for v in values:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        same = x.eqNullSafe(y)
        if tolerance and kinds[v] in ("double", "float"):
            same = same | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)), F.lit(False))
        changed = changed | ~same
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(changed, "changed")
    return joined.withColumn("change", kind).where("change IS NOT NULL").select(*keys, "change")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def by_field(rows: DataFrame, field: Column, key: str) -> DataFrame:
    """The members of each group that a field (a text or an array of texts) names: `group`, `key`; rows without the field belong to none."""
    return rows.select(F.col(key), F.explode(field).alias("group")).where("group IS NOT NULL").distinct()


def with_layout(rows: DataFrame, layout: DataFrame, on: list[str]) -> DataFrame:
    """Rows matched with a plate layout by position: `status` is matched, unplaced (no such well) or unused (a well without a row)."""
    marked = rows.withColumn("_row", F.lit(True)).join(bounded(layout.dropDuplicates(on).withColumn("_well", F.lit(True))), on, "full_outer")
    return marked.withColumn("status", F.when(F.col("_row").isNull(), "unused").when(F.col("_well").isNull(), "unplaced").otherwise("matched")).drop("_row", "_well")


def latest(entries: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """The newest entry of each key; equal times are ordered by `tie`. A maximum per key, so a hot key is combined before the shuffle."""
    rest = [c for c in entries.columns if c not in by]
    best = entries.where(F.col(at).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_b"))
    return best.select(*by, "_b.*")


def class_table(labels: DataFrame, key: str, label: str, classes: list[str], probability: str | None = None) -> DataFrame:
    """One row per event and a column per class: its probability, or 1 and 0 for membership."""
    value = F.col(probability) if probability else F.lit(1)
    return labels.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col(label) == c, value)), F.lit(0)).alias(c) for c in classes])


def classes_of(wide: DataFrame, key: str, classes: list[str], least: float = 0.5) -> DataFrame:
    """The classes of each event whose value is at least `least`: `key`, `class`, `value`."""
    return wide.unpivot([key], classes, "class", "value").where(F.col("value") >= least)


def split_samples(rows: DataFrame, name: str, column: str) -> DataFrame:
    """One sample per distinct value of a column: `sample` is the name with the value, the name alone for null."""
    return rows.withColumn("sample", F.concat_ws(" ", F.lit(name), F.col(column).cast("string")))


def concatenated(parts: dict[str, DataFrame], order: str) -> DataFrame:
    """Samples below each other over the columns that all share, with `sample_id` and the event's number in its sample's `order` (`source_event`, kept from the source)."""
    names = [c for c in next(iter(parts.values())).columns if all(c in p.columns for p in parts.values())]
    rows = [p.select(F.lit(k).alias("sample_id"), F.col(order).alias("source_event"), *[c for c in names if c != order]) for k, p in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def count_differences(before: DataFrame, after: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counts of two tables side by side with their difference, the largest first; a missing one counts 0."""
    a, b = before.select(*keys, F.col(count).alias("before")), after.select(*keys, F.col(count).alias("after"))
    both = a.join(b, keys, "full_outer").fillna(0, ["before", "after"]).withColumn("difference", F.col("after") - F.col("before"))
    return both.orderBy(F.abs("difference").desc(), *keys)
