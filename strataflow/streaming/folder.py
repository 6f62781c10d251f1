"""Streams of landed files: windowed aggregates with late data, per-file checks, and a running record of runs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyspark.sql.types import LongType, StructField, StructType

from strataflow.common import checkpoint_folder, clean


def parquet_stream(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None, since: str | None = None) -> DataFrame:
    """The Parquet table `name` of a folder, read as a stream of its files.

    Files that were there before count too; with `since` (a timestamp) rows of files last changed before it are left out, so that only new ones are followed.
    """
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        stream = stream.option("maxFilesPerTrigger", per_trigger)
    rows = stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if os.path.isfile(path) else stream.parquet(path)
    return rows.where(F.col("_metadata.file_modification_time") >= F.lit(since).cast("timestamp")) if since else rows


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """`path`, `length` and `modificationTime` of a folder's files; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def complete(before: DataFrame, after: DataFrame, end: Column | None = None) -> DataFrame:
    """The files of the later listing that can be read: unchanged in size and time since the earlier one and, where `end` tells the place of their last byte, that long."""
    same = after.join(before, ["path", "length", "modificationTime"], "left_semi").where("length > 0")
    return same.where(F.col("length") > end) if end is not None else same


def file_checks(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Per landed file: rows, and per column the rows without a finite number, its least and greatest value. Every file is checked by itself as it arrives."""
    own = [x for c in columns for x in (F.count_if(clean(F.col(c)).isNull()).alias(f"{c}_missing"), F.min(clean(F.col(c))).alias(f"{c}_least"), F.max(clean(F.col(c))).alias(f"{c}_most"))]
    return stream.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), *own)


def windowed(stream: DataFrame, ts: str, by: str, value: str, width: str, late: str = "1 hour") -> DataFrame:
    """Count and sum per tumbling window; rows later than `late` behind the newest are dropped."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))  # event times need a time zone
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is there, write it to the shared folder with a checkpoint, and read the result."""
    spark = stream.sparkSession
    at = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is tried again writes its own folder again, so each counts exactly once.
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number:09d}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    out = spark.read.schema(schema).parquet(f"{at}/out")
    if mode == "complete":  # each batch holds the whole result
        last = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == F.lit(last))
    return out.drop("batch")


def running_record(stream: DataFrame, by: str, value: str) -> DataFrame:
    """Per key the number, mean and sample variance of all values so far, kept as state and updated by each batch (Chan's formula)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in frames:
            x = pdf[value].dropna()
            if len(x):
                k, m = len(x), float(x.mean())
                gap = m - mean
                mean, m2, n = mean + gap * k / (n + k), m2 + float(((x - m) ** 2).sum()) + gap * gap * n * k / (n + k), n + k
        state.update((n, mean, m2))
        yield pd.DataFrame([(key[0], n, mean, m2 / (n - 1) if n > 1 else None)], columns=[by, "n", "mean", "variance"])

    kind = dict(stream.dtypes)[by]
    return stream.select(by, value).groupBy(by).applyInPandasWithState(update, f"{by} {kind}, n long, mean double, variance double", "n long, mean double, m2 double", "update", GroupStateTimeout.NoTimeout)
