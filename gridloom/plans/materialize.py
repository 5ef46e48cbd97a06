"""Cutting lineage: written tables in the cluster's shared folder.

Iterative operators write each round's state as Parquet below
``spark.checkpoint.dir`` and read it back, so a lost executor costs a re-read
and not the rounds before it. Parquet is compressed and carries sizes, so the
planner sees what a table weighs before choosing a join.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder of our own in a local session and an error on a cluster, whose workers share none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all workers share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_gridloom_path", None)
        if path:
            fs, p = _fs(spark, path)
            fs.delete(p, True)


def materialize(df: DataFrame, files: int | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back.

    ``by``: a column of few values that gets a folder a value, so that reading
    one of them does not open the others. The folder is deleted when the
    session's application ends, or earlier by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom/{uuid.uuid4().hex}"
    out = (df.coalesce(files) if files else df).write
    (out.partitionBy(by) if by else out).parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def counted(df: DataFrame, by: str | None = None, **aggs: Column) -> tuple[DataFrame, dict]:
    """``materialize`` together with aggregates over the rows written, taken on the way and without a job of their own."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in aggs.items()]), by=by)
    return out, seen.get


class Levels:
    """Tables of one schema written one after another and read together in one scan, however many there are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.parts = spark, f"{shared_folder(spark)}/gridloom/{uuid.uuid4().hex}", []
        fs, p = _fs(spark, self.path)
        fs.deleteOnExit(p)

    def add(self, df: DataFrame) -> int:
        """Write a further table; its number of rows."""
        seen = Observation()
        self.schema = df.schema
        self.parts.append(f"{self.path}/part{len(self.parts)}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(self.parts[-1])
        return seen.get["n"]

    def read(self, last: int = 0) -> DataFrame:
        """The last so many tables, by default all."""
        return self.spark.read.schema(self.schema).parquet(*self.parts[-last:])


def sweep(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of finished jobs, which otherwise stay until its next full collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
