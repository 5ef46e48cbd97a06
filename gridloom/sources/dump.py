"""Matrices out as label pairs, lines and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.matrix import Matrix


def _named(ids: str, tab: DataFrame | None, c: DataFrame, out: str) -> DataFrame:
    if tab is None:
        return c.withColumn(out, F.col(ids).cast("string"))
    return c.join(tab.select(F.col("id").alias(f"_{out}"), F.col("label").alias(f"_l{out}")), F.col(ids) == F.col(f"_{out}"), "left").withColumn(out, F.coalesce(f"_l{out}", F.lit("?"))).drop(f"_{out}", f"_l{out}")


def pairs(m: Matrix, col_tab: DataFrame | None = None, row_tab: DataFrame | None = None, half: str | None = None, least: float | None = None) -> DataFrame:
    """(x, y, val): a row a cell. ``half``: ``upper`` keeps row < column, ``upperi`` also equal, ``lower`` row > column, ``loweri`` also equal; ``least`` drops smaller values. Ids without a label read ``?``."""
    c = m.cells
    if half:
        c = c.where({"upper": "row_id < col_id", "upperi": "row_id <= col_id", "lower": "row_id > col_id", "loweri": "row_id >= col_id"}[half])
    if least is not None:
        c = c.where(F.col("val") >= least)
    return _named("row_id", row_tab, _named("col_id", col_tab, c, "x"), "y").select("x", "y", "val")


def lines(m: Matrix, col_tab: DataFrame | None = None, row_tab: DataFrame | None = None, lead: bool = True, sep: str = "\t", values: bool = False) -> DataFrame:
    """(id, line): a line a column with its rows in id order, optionally led by the column and with ``:value``. A column's line is as long as the column."""
    c = _named("row_id", row_tab, m.cells, "y")
    text = F.concat("y", F.lit(":"), F.col("val").cast("string")) if values else F.col("y")
    per = c.groupBy("col_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", text.alias("t")))), lambda x: x["t"]), sep).alias("body"))
    per = m.cols.join(per, F.col("id") == F.col("col_id"), "left").select("id", F.coalesce("body", F.lit("")).alias("body"))
    if lead:
        per = _named("id", col_tab, per, "x").withColumn("body", F.when(F.col("body") == "", F.col("x")).otherwise(F.concat("x", F.lit(sep), "body")))
    return per.select("id", F.col("body").alias("line"))


def table(m: Matrix, row_ids: list[int]) -> DataFrame:
    """One column a listed row id (``r<id>``), a row a matrix column, zeros filled in."""
    agg = [F.coalesce(F.max(F.when(F.col("row_id") == r, F.col("val"))), F.lit(0.0)).alias(f"r{r}") for r in row_ids]
    some = m.cells.where(F.col("row_id").isin(row_ids)).groupBy("col_id").agg(*agg)
    return m.cols.join(some, F.col("id") == F.col("col_id"), "left").select("id", *[F.coalesce(f"r{r}", F.lit(0.0)).alias(f"r{r}") for r in row_ids])


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def nodes_and_edges(m: Matrix, cl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables for drawing: (node, cluster) and (x, y, val) with x < y."""
    return m.cols.join(cl, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), "cluster"), m.cells.where("col_id < row_id").select(F.col("col_id").alias("x"), F.col("row_id").alias("y"), "val")
