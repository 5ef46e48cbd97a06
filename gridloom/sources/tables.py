"""Numeric tables with labels, and tabular alignment reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.reshape import canonical_map

# fixed value: texts that mean not available
NA = ["", "na", "nan", "inf", "-inf", "+inf"]


def read_numeric(lines: DataFrame, skip_rows: int = 0, skip_cols: int = 0, label_col: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((item, attr, val, is_na), tab (id, label)) of TAB-separated lines (``value``, ``line_no``).

    Items are the lines after the skipped ones, numbered from 0 in order;
    attributes the columns after the skipped ones. Texts that mean not
    available, or are no number, give 0 and ``is_na``.
    """
    at = canonical_map(lines.select(F.col("line_no").alias("id"))).select(F.col("old").alias("_o"), F.col("new").alias("_n"))
    rows = lines.join(at, F.col("line_no") == F.col("_o")).where(F.col("_n") >= skip_rows).select((F.col("_n") - skip_rows).alias("item"), F.split("value", "\t", -1).alias("f"))
    cells = rows.select("item", F.posexplode(F.slice("f", F.lit(skip_cols + 1), F.greatest(F.size("f") - skip_cols, F.lit(0)))).alias("attr", "text"))
    v = F.expr("try_cast(trim(text) as double)")
    na = F.lower(F.trim("text")).isin(NA) | v.isNull()
    cells = cells.select("item", F.col("attr").cast("bigint").alias("attr"), F.when(na, 0.0).otherwise(v).alias("val"), na.alias("is_na"))
    tab = rows.select(F.col("item").alias("id"), (F.get("f", F.lit(label_col)) if label_col is not None else F.col("item").cast("string")).alias("label"))
    return cells, tab


def read_numeric_file(spark: SparkSession, path: str, **how) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    return read_numeric(lines, **how)


def read_alignments(lines: DataFrame, score: str = "e", cut: float = 0.0) -> DataFrame:
    """(x, y, val) of 12-column tabular alignment lines, comments skipped: ``e`` gives min(200, −log10 E) with 200 for E = 0, ``b`` the bit score, ``r`` bits over alignment length; only scores above ``cut``."""
    f = lines.where(F.col("value").isNotNull() & ~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 12)
    num = lambda i: F.expr(f"try_cast(trim(f[{i}]) as double)")
    e = F.when(num(10) == 0, 200.0).otherwise(F.least(F.lit(200.0), -F.log10(num(10))))
    v = {"e": e, "b": num(11), "r": num(11) / num(3)}[score]
    return f.select(F.col("f")[0].alias("x"), F.col("f")[1].alias("y"), v.alias("val")).where(F.col("val") > cut)
