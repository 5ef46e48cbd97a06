"""Line streams to matrices: label pairs, numeric pairs and adjacency lines.

A reader takes a DataFrame of lines (``value``, optionally ``line_no``) or a
path, and gives arcs (x, y, val) of labels or ids; ``load`` then maps labels,
merges repeats, mirrors and symmetrises. Everything is split, cast and grouped
inside the engine; no line is seen by Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.edge import Op, apply_cells
from gridloom.matrix import Matrix
from gridloom.operators.reshape import canonical_map
from gridloom.operators.setops import binary, dedupe
from gridloom.plans.ordering import number


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _lines(df: DataFrame) -> DataFrame:
    """(f, ...) fields of the lines that are not blank, comments or null; each line is split once.

    Fields are divided by TABs if the line has one, else by white space. The
    explode of one array is a fence: filters on the fields do not split again.
    """
    keep = ["line_no"] if "line_no" in df.columns else []
    v = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    some = df.where("value IS NOT NULL").select(*keep, v.alias("v")).where(~F.col("v").rlike("^\\s*(#|$)"))
    f = F.when(F.instr("v", "\t") > 0, F.split("v", "\t")).otherwise(F.split(F.trim("v"), "\\s+"))
    return some.select(*keep, F.explode(F.array(f)).alias("f"))


def read_abc(lines: DataFrame) -> DataFrame:
    """(x, y, val): ``label label [value]`` lines. A missing, infinite or NaN value counts as 1. Lines with fewer than two fields or a value that is no number are skipped, as are comments."""
    src = _lines(lines).where(F.size("f") >= 2)
    keep = [c for c in src.columns if c != "f"]
    text = F.get("f", F.lit(2))
    d = F.when(text.isNull() | (F.trim(text) == ""), 1.0).otherwise(F.expr("try_cast(f[2] as double)"))
    got = src.select(*keep, F.col("f")[0].alias("x"), F.col("f")[1].alias("y"), F.explode(F.array(F.when(F.size("f") > 2, d).otherwise(1.0))).alias("d"))
    wild = F.isnan("d") | (F.abs("d") > 3.4028234663852886e38)
    return got.where("d IS NOT NULL AND x <> '' AND y <> ''").select(*keep, "x", "y", F.when(wild, 1.0).otherwise(F.col("d")).alias("val"))


def read_123(lines: DataFrame, max_col: int | None = None, max_row: int | None = None) -> DataFrame:
    """(x, y, val): ``id id [value]`` lines; ids that are no number, negative or above the bounds are skipped."""
    a = read_abc(lines)
    out = a.withColumn("x", F.expr("try_cast(x as bigint)")).withColumn("y", F.expr("try_cast(y as bigint)")).where("x >= 0 AND y >= 0")
    if max_col is not None:
        out = out.where(F.col("x") <= max_col)
    if max_row is not None:
        out = out.where(F.col("y") <= max_row)
    return out


def read_etc(lines: DataFrame, numeric: bool = False, auto_column: bool = False) -> DataFrame:
    """(x, y, val): ``label y1 y2 ...`` adjacency lines with weight 1; ``numeric`` for ids; ``auto_column`` for lines without a label of their own, which take their place among the lines (from 0, by ``line_no``) as column."""
    f = _lines(lines)
    if auto_column:
        at = canonical_map(f.select(F.col("line_no").alias("id"))).select(F.col("old").alias("_o"), F.col("new").alias("x"))
        out = f.join(at, F.col("line_no") == F.col("_o")).select("x", F.explode("f").alias("y"))
    else:
        out = f.select(F.col("f")[0].alias("x"), F.explode(F.slice("f", F.lit(2), F.size("f"))).alias("y"))
    out = out.where("y <> ''").withColumn("val", F.lit(1.0))
    if numeric:
        out = out.withColumn("x", F.expr("try_cast(x as bigint)")).withColumn("y", F.expr("try_cast(y as bigint)")).where("x >= 0 AND y >= 0")
    return out


@dataclass(frozen=True)
class Loaded:
    matrix: Matrix
    col_tab: DataFrame
    row_tab: DataFrame


def label_ids(labels: DataFrame, tab: DataFrame | None = None, mode: str = "extend") -> DataFrame:
    """(id, label): ids of labels. Without a ``tab`` they are numbered in label order; with one, unknown labels get the next ids (``extend``), are ignored (``restrict``) or fail (``strict``)."""
    seen = labels.where("label IS NOT NULL").select("label").distinct()
    if tab is None:
        return number(seen, ["label"], "id").select("id", "label")
    new = seen.join(tab.select(F.col("label").alias("_l")), F.col("label") == F.col("_l"), "left_anti")
    if mode == "restrict":
        return tab.select("id", "label")
    if mode == "strict":
        bad = new.limit(1).collect()
        if bad:
            raise ValueError(f"label {bad[0].label!r} is not in the tab")
        return tab.select("id", "label")
    top = tab.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("m")).first().m
    return tab.select("id", "label").unionByName(number(new, ["label"], "id", top + 1).select("id", "label"))


def load(arcs: DataFrame, ops: list[Op] | None = None, repeats: str = "max", mirror: bool = False, symmetric: str | None = None, tab: DataFrame | None = None, mode: str = "extend", one_domain: bool = True, transpose: bool = False, log10_neg: bool = False) -> Loaded:
    """Arcs of labels (or ids) to a matrix with its label tables.

    ``ops`` change single weights before repeats merge (by ``repeats``: max,
    min, add, mul, first, last by line_no); ``mirror`` adds every arc's reverse;
    ``symmetric`` merges with the transpose (max, min, add, mul, where mul keeps
    a lone arc). Ids of numeric streams are kept as they are.
    """
    if log10_neg:
        arcs = arcs.withColumn("val", F.when(F.col("val") > 0, -F.log10("val")).otherwise(0.0))
    if mirror:
        arcs = arcs.unionByName(arcs.withColumn("_x", F.col("y")).withColumn("y", F.col("x")).withColumn("x", F.col("_x")).drop("_x"))
    numeric = dict(arcs.dtypes)["x"] == "bigint"
    if numeric:
        c = arcs.withColumn("col_id", F.col("x")).withColumn("row_id", F.col("y"))
        ids = lambda k: arcs.select(F.col(k).alias("id")).distinct()
        cols = rows = ids("x").union(ids("y")).distinct()
        if not one_domain:
            cols, rows = ids("x"), ids("y")
        col_tab, row_tab = (d.select("id", F.col("id").cast("string").alias("label")) for d in (cols, rows))
    else:
        lab = lambda k: arcs.select(F.col(k).alias("label"))
        if one_domain:
            col_tab = row_tab = label_ids(lab("x").union(lab("y")), tab, mode)
        else:
            col_tab, row_tab = label_ids(lab("x"), tab, mode), label_ids(lab("y"), None)
        c = arcs.join(col_tab.select(F.col("id").alias("col_id"), F.col("label").alias("_lx")), F.col("x") == F.col("_lx")).join(row_tab.select(F.col("id").alias("row_id"), F.col("label").alias("_ly")), F.col("y") == F.col("_ly"))
        cols, rows = col_tab.select("id"), row_tab.select("id")
    position = "line_no" if "line_no" in arcs.columns else None
    c = c.select("col_id", "row_id", "val", *([position] if position else []))
    if ops:
        if position:
            raise ValueError("weights are changed before lines are numbered; apply ops to the arcs instead")
        c = apply_cells(c, ops)
    m = Matrix(dedupe(c, repeats, position), cols, rows)
    if symmetric:
        m = binary(m, m.t, "cross" if symmetric == "mul" else symmetric)
    return Loaded(m.t if transpose else m, row_tab if transpose else col_tab, col_tab if transpose else row_tab)


def assemble(raw: DataFrame, repeats: str = "max", vectors: str = "max", image: str | None = "max") -> Matrix:
    """Raw vectors (col_id, row_id, val, vector_no) to a graph: entries repeated within a vector merge by ``repeats``, repeated vectors of a column by ``vectors``, and the result with its transpose by ``image``."""
    one = raw.groupBy("col_id", "vector_no", "row_id").agg(_agg(repeats).alias("val"))
    m = Matrix.graph(one.groupBy("col_id", "row_id").agg(_agg(vectors).alias("val")).where("val <> 0"))
    return binary(m, m.t, "cross" if image == "mul" else image) if image else m


def _agg(how: str) -> Column:
    return {"max": F.max, "min": F.min, "add": F.sum, "mul": F.product, "left": F.first, "right": F.last}[how]("val")


def read_raw(lines: DataFrame) -> DataFrame:
    """(col_id, row_id, val, vector_no) of headerless vectors ``id idx[:val] ... $``, one a line (``value``, ``line_no``); a missing value is 1."""
    f = lines.where(F.col("value").isNotNull() & (F.trim("value") != "")).select("line_no", F.split(F.trim(F.regexp_replace("value", "\\$\\s*$", "")), "\\s+").alias("f"))
    e = f.select("line_no", F.expr("try_cast(f[0] as bigint)").alias("col_id"), F.explode(F.slice("f", F.lit(2), F.size("f"))).alias("e")).where("e <> ''")
    p = F.split("e", ":")
    e = e.withColumn("_i", p[0]).withColumn("_v", F.get(p, F.lit(1)))
    return e.select("col_id", F.expr("try_cast(_i as bigint)").alias("row_id"), F.coalesce(F.expr("try_cast(_v as double)"), F.lit(1.0)).alias("val"), F.col("line_no").alias("vector_no")).where("col_id IS NOT NULL AND row_id IS NOT NULL")


def read_tab(lines: DataFrame) -> DataFrame:
    """(id, label) of ``id<white space>label`` lines; comments and lines of another shape are skipped."""
    p = "^\\s*(\\d+)\\s+(.*?)\\r?$"
    return lines.where(F.col("value").rlike(p) & ~F.col("value").rlike("^\\s*#")).select(F.regexp_extract("value", p, 1).cast("bigint").alias("id"), F.regexp_extract("value", p, 2).alias("label"))
