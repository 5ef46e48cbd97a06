"""Joins and set operations of matrices, columns and domains, and sparse products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.merge import MERGES, REPEATS, Merge, arc_filter
from gridloom.matrix import CELL, Matrix, domain


def union_domain(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def merge_cells(a: DataFrame, b: DataFrame, f: Merge) -> DataFrame:
    """Cell by cell over the union of positions.

    Both sides are tagged and summed by position rather than joined: repeats of
    neither exist, one shuffle does, and partial sums are taken before it.
    """
    tagged = a.select("col_id", "row_id", F.col("val").alias("l"), F.lit(0.0).alias("r")).unionByName(b.select("col_id", "row_id", F.lit(0.0).alias("l"), F.col("val").alias("r")))
    both = tagged.groupBy("col_id", "row_id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return both.select("col_id", "row_id", f(F.col("l"), F.col("r")).alias("val")).where("val <> 0").select(*CELL)


def binary(a: Matrix, b: Matrix, op: str | Merge) -> Matrix:
    """``op`` over both matrices' cells, domains joined; positions absent from both stay absent."""
    f = MERGES[op] if isinstance(op, str) else op
    return Matrix(merge_cells(a.cells, b.cells, f), union_domain(a.cols, b.cols), union_domain(a.rows, b.rows))


def hadamard(a: Matrix, b: Matrix) -> Matrix:
    return binary(a, b, "mul")


def merge_transpose(m: Matrix, op: str | Merge, diagonal: float = 1.0) -> Matrix:
    """``op`` of each arc and its reverse, loops then multiplied by ``diagonal``."""
    out = binary(m, m.t, op)
    c = out.cells.withColumn("val", F.when(F.col("col_id") == F.col("row_id"), F.col("val") * diagonal).otherwise(F.col("val")))
    return out.put(c)


def arc_select(m: Matrix, kind: str, cmp: str, a: float) -> Matrix:
    return merge_transpose(m, arc_filter(kind, cmp, a))


def add_transpose(m: Matrix, diagonal: float = 0.5) -> Matrix:
    """M plus its transpose; a diagonal weight of 1 doubles loops, 0.5 keeps them, 0 removes them."""
    return merge_transpose(m, "add", diagonal)


def mutual(m: Matrix) -> Matrix:
    """Arcs whose reverse exists."""
    return binary(m, m.t, "and")


def restrict_columns(a: Matrix, b: Matrix, keep: bool) -> Matrix:
    """Cells of ``a`` at positions that ``b`` has (meet) or lacks (difference), values of ``a``."""
    return Matrix(merge_cells(a.cells, b.cells, MERGES["and" if keep else "and_not"]), a.cols, a.rows)


def update_where(a: Matrix, b: Matrix, f: Merge, meet: bool = True) -> Matrix:
    """Replace values of ``a`` by ``f`` only where ``b`` has the cell (or, with ``meet`` false, lacks it)."""

    def g(l, r):
        hit = (r != 0) if meet else (r == 0)
        return F.when(l == 0, 0.0).when(hit, f(l, r)).otherwise(l)

    return Matrix(merge_cells(a.cells, b.cells, g), a.cols, a.rows)


def inner_products(a: Matrix, b: Matrix) -> DataFrame:
    """(col_id, val): the inner product of equally named columns."""
    return merge_cells(a.cells, b.cells, MERGES["mul"]).groupBy("col_id").agg(F.sum("val").alias("val"))


def count_parts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (left_only, both, right_only) of two domains."""
    t = a.select("id", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select("id", F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = t.groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    n = lambda x, y: F.coalesce(F.sum(((F.col("l") == x) & (F.col("r") == y)).cast("bigint")), F.lit(0))
    return per.agg(n(1, 0).alias("left_only"), n(1, 1).alias("both"), n(0, 1).alias("right_only"))


def relate(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of predicates on two domains: equal, super, sub, disjoint, meet, trisphere (all three parts), ldiff, rdiff."""
    p = count_parts(a, b)
    l, m, r = (F.col(c) > 0 for c in ("left_only", "both", "right_only"))
    return p.select((~l & ~r).alias("equal"), (~r).alias("super"), (~l).alias("sub"), (~m).alias("disjoint"), m.alias("meet"), (l & m & r).alias("trisphere"), l.alias("ldiff"), r.alias("rdiff"))


def domain_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(F.col("id").alias("_b")), F.col("id") == F.col("_b"), "left_anti")


def domain_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(F.col("id").alias("_b")), F.col("id") == F.col("_b"), "left_semi")


def embed(vec: DataFrame, dom: DataFrame, default: float = 0.0) -> DataFrame:
    """(id, val) over the whole domain, ``default`` where ``vec`` (id, val) has nothing."""
    return dom.join(vec.select(F.col("id").alias("_v"), "val"), F.col("id") == F.col("_v"), "left").select("id", F.coalesce("val", F.lit(default)).alias("val"))


def compose(a: Matrix, b: Matrix) -> Matrix:
    """The product A B: columns of B, rows of A. The join on the inner index is hashed, sums are partial before their shuffle; a skewed index is split by the adaptive planner."""
    l = b.cells.select(F.col("row_id").alias("k"), "col_id", F.col("val").alias("v"))
    r = a.cells.select(F.col("col_id").alias("k"), "row_id", F.col("val").alias("w"))
    out = l.join(r, "k").groupBy("col_id", "row_id").agg(F.sum(F.col("v") * F.col("w")).alias("val"))
    return Matrix(out.where("val <> 0").select(*CELL), b.cols, a.rows)


def matrix_power(m: Matrix, n: int) -> Matrix:
    """M to the n-th, by squaring."""
    if n == 0:
        return identity(m.cols)
    half = matrix_power(m, n // 2) if n > 1 else None
    if half is None:
        return m
    sq = compose(half, half)
    return compose(sq, m) if n % 2 else sq


def step(m: Matrix, k: int = 2) -> Matrix:
    """``k`` squarings, that is M to the power 2^k."""
    for _ in range(k):
        m = compose(m, m)
    return m


def times_vector(m: Matrix, vec: DataFrame) -> DataFrame:
    """M v as (id, val)."""
    v = vec.select(F.col("id").alias("k"), F.col("val").alias("v"))
    return m.cells.join(v, F.col("col_id") == F.col("k")).groupBy(F.col("row_id").alias("id")).agg(F.sum(F.col("val") * F.col("v")).alias("val")).where("val <> 0")


def dedupe(rows: DataFrame, how: str = "max", position: str | None = None) -> DataFrame:
    """Repeated (col_id, row_id) become one cell; ``first`` and ``last`` follow the ``position`` column."""
    p = F.col(position) if position else F.lit(0)
    return rows.groupBy("col_id", "row_id").agg(REPEATS[how](F.col("val"), p).alias("val")).where("val <> 0").select(*CELL)


def identity(dom: DataFrame, c: float = 1.0) -> Matrix:
    return Matrix(dom.select(F.col("id").alias("col_id"), F.col("id").alias("row_id"), F.lit(float(c)).alias("val")), dom, dom)


def diagonal(vec: DataFrame) -> Matrix:
    d = vec.select(F.col("id").alias("col_id"), F.col("id").alias("row_id"), "val").where("val <> 0")
    return Matrix(d, vec.select("id"), vec.select("id"))


def all_cells(cols: DataFrame, rows: DataFrame, val: float = 1.0) -> Matrix:
    """Every cell of two domains. The result is that large by definition; for domains of a few ids."""
    one = cols.select(F.col("id").alias("col_id"), F.lit(1).alias("_k")).join(rows.select(F.col("id").alias("row_id"), F.lit(1).alias("_k")), "_k")
    return Matrix(one.select("col_id", "row_id", F.lit(float(val)).alias("val")), cols, rows)


def merge_into_column(m: Matrix, vec: DataFrame, col: int, op: str) -> Matrix:
    """``op`` of one column and a vector (id, val)."""
    v = vec.select(F.lit(col).cast("bigint").alias("col_id"), F.col("id").alias("row_id"), "val")
    own = m.cells.where(F.col("col_id") == col)
    rest = m.cells.where(F.col("col_id") != col)
    cells = rest.unionByName(merge_cells(own, v, MERGES[op]))
    return Matrix(cells, union_domain(m.cols, domain(v, "col_id")), union_domain(m.rows, vec))
