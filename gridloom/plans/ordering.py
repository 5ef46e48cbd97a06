"""Global positions and running sums without a single task that sees all rows.

Rows are range-partitioned and sorted, numbered inside their partition and
written once with that number, so every later reading agrees; a partition then
starts where the ones before it end. Only one row a partition is summed up
centrally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.plans.materialize import materialize

_LOW = (1 << 33) - 1


def _placed(df: DataFrame, by: list[Column | str]) -> DataFrame:
    s = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(s.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))))


def _starts(placed: DataFrame, size: Column) -> DataFrame:
    per = placed.groupBy(F.col("_p").alias("_q")).agg(size.alias("_n"))
    before = F.sum("_n").over(W.orderBy("_q").rowsBetween(W.unboundedPreceding, -1))  # a row a partition
    return F.broadcast(per.select("_q", F.coalesce(before, F.lit(0)).alias("_s")))


def number(df: DataFrame, by: list[Column | str], name: str = "position", start: int = 0) -> DataFrame:
    """``df`` with its global position under ``by``, from ``start``; ties are numbered in some order."""
    t = _placed(df, by)
    out = t.join(_starts(t, F.count("*")), F.col("_p") == F.col("_q"))
    return out.select(*df.columns, (F.col("_s") + F.col("_i") + start).cast("bigint").alias(name))


def running(df: DataFrame, by: list[Column | str], value: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows under ``by``."""
    t = _placed(df, by)
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_p").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = t.withColumn("_r", inside).join(_starts(t, F.sum(value)), F.col("_p") == F.col("_q"))
    return out.select(*df.columns, (F.col("_s") + F.col("_r")).alias(name))
