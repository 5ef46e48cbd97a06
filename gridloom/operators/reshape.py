"""Sub-matrices, domain changes, relabelling, loops and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.merge import MERGES
from gridloom.matrix import CELL, Matrix, domain, within
from gridloom.operators.setops import binary, domain_meet, union_domain
from gridloom.plans.ordering import number

def _loop() -> Column:
    return F.col("col_id") == F.col("row_id")


def sub(m: Matrix, cols: DataFrame | None = None, rows: DataFrame | None = None) -> Matrix:
    """The block on the given ids; domains become those ids."""
    c = m.cols if cols is None else domain_meet(m.cols, cols)
    r = m.rows if rows is None else domain_meet(m.rows, rows)
    return Matrix(within(m.cells, None if cols is None else c, None if rows is None else r), c, r)


def reduce(m: Matrix, cols: DataFrame | None = None, rows: DataFrame | None = None) -> Matrix:
    """The cells of ``sub``, domains kept."""
    return m.put(within(m.cells, cols, rows))


def extended_sub(m: Matrix, cols: DataFrame, rows: DataFrame) -> Matrix:
    """Cells with their column in ``cols`` or their row in ``rows``, domains kept."""
    a = m.cells.join(cols.select(F.col("id").alias("_c")), F.col("col_id") == F.col("_c"), "left").join(rows.select(F.col("id").alias("_r")), F.col("row_id") == F.col("_r"), "left")
    return m.put(a.where("_c IS NOT NULL OR _r IS NOT NULL"))


def lower(m: Matrix) -> Matrix:
    """Cells with row < column."""
    return m.put(m.cells.where("row_id < col_id"))


def upper(m: Matrix) -> Matrix:
    return m.put(m.cells.where("row_id > col_id"))


def characteristic(m: Matrix, val: float = 1.0) -> Matrix:
    return m.put(m.cells.withColumn("val", F.lit(float(val))))


def change_domains(m: Matrix, cols: DataFrame | None = None, rows: DataFrame | None = None) -> Matrix:
    """New domains: ids may come and go, cells outside are dropped."""
    return Matrix(within(m.cells, cols, rows), m.cols if cols is None else cols, m.rows if rows is None else rows)


def accommodate(m: Matrix, cols: DataFrame, rows: DataFrame) -> Matrix:
    """Enlarged domains."""
    return Matrix(m.cells, union_domain(m.cols, cols), union_domain(m.rows, rows))


def scrub(m: Matrix, mode: str = "both") -> Matrix:
    """Domains shrunk to ids with cells: ``cols``, ``rows``, ``both`` or ``graph`` (ids with cells as either)."""
    if mode == "graph":
        d = domain(m.cells, "col_id", "row_id")
        return Matrix(m.cells, d, d)
    return Matrix(m.cells, domain(m.cells, "col_id") if mode in ("cols", "both") else m.cols, domain(m.cells, "row_id") if mode in ("rows", "both") else m.rows)


def affine_map(dom: DataFrame, mul: int = 1, shift: int = 0) -> DataFrame:
    """(old, new) with new = old * mul + shift."""
    return dom.select(F.col("id").alias("old"), (F.col("id") * mul + shift).alias("new"))


def canonical_map(dom: DataFrame) -> DataFrame:
    """(old, new): ids renumbered 0 .. n-1 in ascending order."""
    return number(dom.select(F.col("id").alias("old")).distinct(), ["old"], "new")


def map_ids(m: Matrix, col_map: DataFrame | None = None, row_map: DataFrame | None = None) -> Matrix:
    """Relabel by (old, new) bijections; ids without a new name are dropped."""
    c, cols, rows = m.cells, m.cols, m.rows
    if col_map is not None:
        cm = col_map.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        c = c.join(cm, F.col("col_id") == F.col("_o")).select(F.col("_n").alias("col_id"), "row_id", "val")
        cols = cols.join(cm, F.col("id") == F.col("_o")).select(F.col("_n").alias("id"))
    if row_map is not None:
        rm = row_map.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        c = c.join(rm, F.col("row_id") == F.col("_o")).select("col_id", F.col("_n").alias("row_id"), "val")
        rows = rows.join(rm, F.col("id") == F.col("_o")).select(F.col("_n").alias("id"))
    return Matrix(c, cols, rows)


def is_bijection(old_new: DataFrame) -> bool:
    r = old_new.agg(F.count("*").alias("n"), F.countDistinct("old").alias("o"), F.countDistinct("new").alias("w")).first()
    return r.n == r.o == r.w


def drop_loops(m: Matrix) -> Matrix:
    return m.put(m.cells.where("col_id <> row_id"))


def scale_loops(m: Matrix, f: float) -> Matrix:
    return m.put(m.cells.withColumn("val", F.when(_loop(), F.col("val") * f).otherwise(F.col("val"))))


def set_loops(m: Matrix, how: str = "max") -> Matrix:
    """Loops of every node: ``remove``, ``max`` or ``sum`` of the column without its loop (1 where that is 0), ``one`` everywhere, ``empty`` 1 where a column has no cells."""
    if how == "remove":
        return drop_loops(m)
    off = m.cells if how == "empty" else m.cells.where("col_id <> row_id")
    stat = off.groupBy("col_id").agg((F.sum("val") if how == "sum" else F.max("val")).alias("s")).select(F.col("col_id").alias("_c"), "s")
    v = {"one": F.lit(1.0), "empty": F.when(F.col("s").isNull(), 1.0).otherwise(0.0)}.get(how, F.when(F.coalesce("s", F.lit(0.0)) != 0, F.col("s")).otherwise(1.0))
    loops = m.cols.join(stat, F.col("id") == F.col("_c"), "left").select(F.col("id").alias("col_id"), F.col("id").alias("row_id"), v.alias("val"))
    return m.put(off.unionByName(loops))


def block_union(m: Matrix, clustering: DataFrame, inside: bool = True) -> Matrix:
    """Arcs inside any cluster of (cluster, node), or with ``inside`` false the arcs that no cluster holds. Overlapping clusters are allowed."""
    a = clustering.select(F.col("node").alias("_a"), F.col("cluster").alias("_k"))
    b = clustering.select(F.col("node").alias("_b"), F.col("cluster").alias("_k2"))
    hit = m.cells.join(a, F.col("col_id") == F.col("_a")).join(b, (F.col("row_id") == F.col("_b")) & (F.col("_k") == F.col("_k2"))).select("col_id", "row_id", "val").distinct()
    if inside:
        return m.put(hit)
    keys = hit.select(F.col("col_id").alias("_x"), F.col("row_id").alias("_y"))
    return m.put(m.cells.join(keys, (F.col("col_id") == F.col("_x")) & (F.col("row_id") == F.col("_y")), "left_anti"))


def block_partition(m: Matrix, clustering: DataFrame, quantile: float = 0.5) -> Matrix:
    """Arcs inside clusters above the ``quantile`` of the arcs that leave the node's cluster; both directions must pass, loops are kept at half."""
    out = block_union(m, clustering, inside=False).cells
    bar = out.groupBy(F.col("col_id").alias("_c")).agg(F.percentile("val", F.lit(quantile)).alias("bar"))
    own = block_union(m, clustering).cells.join(bar, F.col("col_id") == F.col("_c"), "left").where("bar IS NULL OR val > bar").select(*CELL)
    kept = m.put(own)
    return scale_loops(binary(kept, kept.t, "min"), 0.5)


def unlink_nodes(m: Matrix, least: int = 0, most: int | None = None) -> Matrix:
    """Drop nodes whose degree lies outside the bounds, with all their arcs; domains kept."""
    deg = m.cells.groupBy(F.col("col_id").alias("_d")).agg(F.count("*").alias("n"))
    d = m.cols.join(deg, F.col("id") == F.col("_d"), "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") >= least)
    if most is not None:
        d = d.where(F.col("n") <= most)
    d = d.select("id")
    return m.put(within(m.cells, d, d))


def fold(m: Matrix, duplicates: DataFrame) -> Matrix:
    """Fold (node, representative) duplicates into their representative by largest weight, then symmetrise by largest weight."""
    a = duplicates.select(F.col("node").alias("_a"), F.col("representative").alias("_ra"))
    b = duplicates.select(F.col("node").alias("_b"), F.col("representative").alias("_rb"))
    c = m.cells.join(a, F.col("col_id") == F.col("_a"), "left").join(b, F.col("row_id") == F.col("_b"), "left")
    c = c.select(F.coalesce("_ra", "col_id").alias("col_id"), F.coalesce("_rb", "row_id").alias("row_id"), "val").groupBy("col_id", "row_id").agg(F.max("val").alias("val"))
    gone = duplicates.where("node <> representative").select(F.col("node").alias("_g"))
    nodes = m.cols.join(gone, F.col("id") == F.col("_g"), "left_anti")
    g = Matrix(c, nodes, nodes)
    return binary(g, g.t, MERGES["max"])


def upsert(m: Matrix, col: int, row: int, val: float) -> Matrix:
    spark = m.cells.sparkSession
    one = spark.range(1).select(F.lit(col).cast("bigint").alias("col_id"), F.lit(row).cast("bigint").alias("row_id"), F.lit(float(val)).alias("val"))
    rest = m.cells.where(~((F.col("col_id") == col) & (F.col("row_id") == row)))
    return Matrix(rest.unionByName(one).where("val <> 0"), union_domain(m.cols, domain(one, "col_id")), union_domain(m.rows, domain(one, "row_id")))


def remove_cell(m: Matrix, col: int, row: int) -> Matrix:
    return m.put(m.cells.where(~((F.col("col_id") == col) & (F.col("row_id") == row))))


def append_columns(m: Matrix, vectors: DataFrame) -> Matrix:
    """Append (vector, id, val) as new columns numbered after the largest column id."""
    top = m.cols.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    ids = number(vectors.select("vector").distinct(), ["vector"], "col_id", top + 1)
    new = vectors.join(ids, "vector").select("col_id", F.col("id").alias("row_id"), "val")
    return Matrix(m.cells.unionByName(new.where("val <> 0")), union_domain(m.cols, domain(new, "col_id")), union_domain(m.rows, domain(new, "row_id")))
