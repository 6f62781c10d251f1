"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a table that is sent whole to every task.
BROADCAST_LIMIT = 8 * 1024 * 1024


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_strataflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="strataflow-", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    sc.addPyFile(out.name)
    sc._strataflow_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of a data folder, pruned to `columns` (all when none are given)."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def first_delivery(df: DataFrame, key: str) -> DataFrame:
    """One row per id: redelivered rows carry the same content, so any one of them will do."""
    return df.dropDuplicates([key])


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage and results of streams: the cluster's setting. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and is computed once."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Mark `df` for broadcast only when its estimated size is within `limit`; otherwise Spark picks a shuffle join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def clean(c: Column) -> Column:
    """The value as a double, null unless finite."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Join rows with one row per group, where null is a group like any other. Without groups `right` is a single row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], *[c for c in right.columns if c not in by])
    same = [left[c].eqNullSafe(renamed[f"_g{k}"]) for k, c in enumerate(by)]
    return left.join(renamed, same, how).drop(*[f"_g{k}" for k in range(len(by))])
