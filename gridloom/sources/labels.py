"""Label tables (id, label): lookup, selection, renumbering and set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(tab: DataFrame) -> DataFrame:
    """One row an id: null ids and labels are dropped, of several labels the smallest stays."""
    return tab.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.min("label").alias("label"))


def lookup(ids: DataFrame, tab: DataFrame) -> DataFrame:
    """(id, label) of ids, ``?`` for ids without a label."""
    return ids.join(tab.select(F.col("id").alias("_i"), "label"), F.col("id") == F.col("_i"), "left").select("id", F.coalesce("label", F.lit("?")).alias("label"))


def select(tab: DataFrame, ids: DataFrame) -> DataFrame:
    return tab.join(ids.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_semi")


def remap(tab: DataFrame, old_new: DataFrame) -> DataFrame:
    return tab.join(old_new, F.col("id") == F.col("old")).select(F.col("new").alias("id"), "label")


def duplicated(tab: DataFrame) -> DataFrame:
    """(label, n, first_id): labels of more than one id."""
    return tab.groupBy("label").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def of_domain(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.col("id").cast("string").alias("label"))


def combine(tabs: list[DataFrame], how: str) -> DataFrame:
    """(label) by set algebra: ``meet`` in all, ``merge`` in any, ``left`` only in the first."""
    out = None
    for i, t in enumerate(tabs):
        one = t.where("label IS NOT NULL").select("label").distinct().withColumn("first", F.lit(int(i == 0)))
        out = one if out is None else out.unionByName(one)
    n = out.groupBy("label").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    if how == "meet":
        n = n.where(F.col("n") == len(tabs))
    elif how == "left":
        n = n.where("n = 1 AND first = 1")
    return n.select("label")


def collect_values(tables: list[DataFrame], how: str = "add") -> DataFrame:
    """(label, val) tables joined by label: ``add`` sums them, ``paste`` gives a column a table (val_0, val_1, ...)."""
    out = None
    for i, t in enumerate(tables):
        one = t.select("label", *[(F.col("val") if j == i else F.lit(None).cast("double")).alias(f"val_{j}") for j in range(len(tables))])
        out = one if out is None else out.unionByName(one)
    per = out.groupBy("label").agg(*[F.sum(f"val_{j}").alias(f"val_{j}") for j in range(len(tables))])
    if how == "paste":
        return per
    total = F.lit(0.0)
    for j in range(len(tables)):
        total = total + F.coalesce(f"val_{j}", F.lit(0.0))
    return per.select("label", total.alias("val"))


def value_summary(values: DataFrame) -> DataFrame:
    return values.agg(F.min("val").alias("least"), F.percentile("val", F.lit(0.5)).alias("median"), F.max("val").alias("most"), F.avg("val").alias("mean"))
