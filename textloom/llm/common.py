"""Helpers shared by the operators: reading tables, cutting lineage, spread-out numbering."""

from __future__ import annotations

import atexit
import functools
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of other bytes than these: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where all run in one process (tests); on a cluster it must be named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local_folder()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder. Like ``cut`` they end the lineage, but they are columnar, their sizes are known to the
    planner, and they can be dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """The rows of ``df`` read back. Aggregates named in ``metrics`` are taken on the way and found in ``seen``."""
        path = f"{self.folder}/{len(self.paths)}"
        watch = Observation() if metrics else None
        schema = df.schema
        if watch:
            df = df.observe(watch, *(c.alias(k) for k, c in metrics.items()))
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = (path, out, watch.get if watch else {})
        return out

    def seen(self, kept: DataFrame) -> dict:
        return self.paths[id(kept)][2]

    def drop(self, *kept: DataFrame) -> None:
        context = self.spark.sparkContext
        for df in kept:
            path = context._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][0])
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def buckets_for(rows: int, per_bucket: int, most: int = 1 << 20) -> int:
    return max(1, min(most, math.ceil(rows / per_bucket)))


def numbered(df: DataFrame, group: list[str], order: list[Column], rows: int, groups: int, name: str, per_bucket: int = 20_000) -> DataFrame:
    """Adds ``name``: 0, 1, 2... without gaps in each group. No task sees a whole group: rows are
    numbered in hash buckets, and each bucket starts after the rows of those before it. The order
    within a bucket is ``order``, which must tell rows apart for a reproducible result."""
    n = buckets_for(rows, per_bucket * max(1, groups))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.struct(*order)), F.lit(n)))
    starts = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    df = df.withColumn("_at", F.row_number().over(within) - 1)
    on = [df[c].eqNullSafe(starts[c]) for c in [*group, "_bucket"]]
    out = df.join(starts, on, "inner").select(df["*"], (df["_at"] + starts["_start"]).alias(name))
    return out.drop("_bucket", "_at")
