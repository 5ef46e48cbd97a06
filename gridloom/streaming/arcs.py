"""Arcs that keep arriving: label lines to an up-to-date graph with Structured Streaming.

The parsers of ``sources.streams`` are plain projections and run unchanged on a
stream. Repeated arcs merge in the stateful aggregation; with a watermark, arcs
per event-time window leave the state once the window is past.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.merge import REPEATS
from gridloom.plans.materialize import shared_folder
from gridloom.sources import streams


def follow(spark, path: str, schema) -> DataFrame:
    """A stream of the Parquet rows of a folder, or of the one file at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    if not one:
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def arcs(lines: DataFrame, layout: str = "abc") -> DataFrame:
    """(x, y, val) of a stream of lines in ``value``."""
    return {"abc": streams.read_abc, "123": streams.read_123, "etc": streams.read_etc}[layout](lines)


def merged(stream: DataFrame, repeats: str = "max") -> DataFrame:
    """(x, y, val): one row an arc, updated as repeats arrive (output mode ``update`` or ``complete``)."""
    return stream.groupBy("x", "y").agg(REPEATS[repeats](F.col("val"), F.lit(0)).alias("val"))


def windowed(stream: DataFrame, time: str, width: str, late: str, repeats: str = "max", slide: str | None = None) -> DataFrame:
    """(start, x, y, val): arcs merged within event-time windows; arcs later than ``late`` are dropped and finished windows leave the state."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), "x", "y").agg(REPEATS[repeats](F.col("val"), F.lit(0)).alias("val"))
    return g.select(F.col("w.start").alias("start"), "x", "y", "val")


def start(df: DataFrame, name: str, mode: str = "complete"):
    """A running query into the in-memory table ``name``, checkpointed in the shared folder."""
    at = f"{shared_folder(df.sparkSession)}/gridloom/streams/{name}"
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", at).start()


def upsert(df: DataFrame, path: str, mode: str = "update"):
    """A running query that writes each batch's changed arcs to ``path`` as Parquet, a folder a batch; the newest batch of an arc holds its value, so a batch written again replaces itself."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/_checkpoint").start()


def latest(spark, path: str) -> DataFrame:
    """(x, y, val): the arcs as of the newest batch written by ``upsert``."""
    return spark.read.parquet(path).groupBy("x", "y").agg(F.max_by("val", "batch").alias("val"))
