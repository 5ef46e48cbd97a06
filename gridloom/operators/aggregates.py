"""Per-column and whole-matrix aggregates, normalisation, ranks and selections by rank.

Aggregates that only reduce use partial sums before their shuffle. Those that
give every cell back next to its column's aggregates join the two. Only ranks
use a window over the column; a rank up to k is cut to k candidates a column
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.matrix import CELL, Matrix
from gridloom.operators.setops import mutual
from gridloom.plans.ordering import number


def _col() -> W:
    return W.partitionBy("col_id")


def _beside(cells: DataFrame, *aggs: Column) -> DataFrame:
    """Cells next to aggregates of their column.

    A join and no window: the aggregates are made from partial ones, are
    broadcast where the planner finds them small, and a column that holds a large
    part of all cells is split by the adaptive planner.
    """
    s = cells.groupBy(F.col("col_id").alias("_s")).agg(*aggs)
    return cells.join(s, F.col("col_id") == F.col("_s"))


def column_stats(m: Matrix, power: float = 2.0, complete: bool = True) -> DataFrame:
    """(col_id, n, total, power_sum, norm, top, least, highest_row, self_val, has_loop) of every column; ``complete`` keeps empty columns with zeros, null extremes and -1 for the highest row."""
    loop = F.col("col_id") == F.col("row_id")
    ps = F.sum(F.pow("val", F.lit(power)))
    s = m.cells.groupBy("col_id").agg(
        F.count("*").alias("n"), F.sum("val").alias("total"), ps.alias("power_sum"), F.pow(ps, F.lit(1 / power)).alias("norm"), F.max("val").alias("top"), F.min("val").alias("least"),
        F.max("row_id").alias("highest_row"), F.max(F.when(loop, F.col("val"))).alias("self_val"), F.max(loop.cast("int")).alias("has_loop"),
    )
    if not complete:
        return s
    z = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return m.cols.join(s, F.col("id") == F.col("col_id"), "left").select(F.col("id").alias("col_id"), z("n", 0), z("total", 0.0), z("power_sum", 0.0), z("norm", 0.0), "top", "least", z("highest_row", -1), z("self_val", 0.0), z("has_loop", 0))


def row_sizes(m: Matrix) -> DataFrame:
    """(row_id, n) with zeros for empty rows."""
    s = m.cells.groupBy("row_id").agg(F.count("*").alias("n"))
    return m.rows.join(s, F.col("id") == F.col("row_id"), "left").select(F.col("id").alias("row_id"), F.coalesce("n", F.lit(0)).alias("n"))


def summary(m: Matrix) -> DataFrame:
    """One row: number of cells, their mass and the largest."""
    return m.cells.agg(F.count("*").alias("n_cells"), F.coalesce(F.sum("val"), F.lit(0.0)).alias("mass"), F.max("val").alias("top"))


def mean_sd(m: Matrix) -> DataFrame:
    """(col_id, mean, sd): over the whole row domain, absent cells counting as 0; population deviation."""
    n = m.rows.count()
    s = m.cells.groupBy("col_id").agg(F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("q"))
    mean = F.col("s") / n
    return s.select("col_id", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))).alias("sd"))


def diagonal_values(m: Matrix) -> DataFrame:
    return m.cells.where("col_id = row_id").select(F.col("col_id").alias("id"), "val")


def stochastic(m: Matrix) -> Matrix:
    """Columns divided by their sum; a column of non-positive sum is emptied."""
    return inflate(m, 1.0)


def inflate(m: Matrix, power: float) -> Matrix:
    """v^r over the column's sum of v^r."""
    p = F.pow("val", F.lit(float(power))) if power != 1 else F.col("val")
    c = _beside(m.cells.select("col_id", "row_id", p.alias("p")), F.sum("p").alias("s")).where("s > 0")
    return m.put(c.select("col_id", "row_id", (F.col("p") / F.col("s")).alias("val")))


def hadamard_power(m: Matrix, power: float) -> Matrix:
    return m.put(m.cells.withColumn("val", F.pow("val", F.lit(float(power)))))


def affine(m: Matrix) -> DataFrame:
    """Cells as z-scores of their column's present cells; a column without spread is only centred. Zero scores are kept, this is a table and no matrix."""
    c = _beside(m.cells, F.avg("val").alias("_m"), F.stddev_pop("val").alias("_d"))
    off = F.col("val") - F.col("_m")
    return c.select("col_id", "row_id", F.when(F.col("_d") > 0, off / F.col("_d")).otherwise(off).alias("val"))


def norm_self(m: Matrix) -> Matrix:
    """Columns divided by their loop, by their largest value where they have none."""
    own = F.max(F.when(F.col("col_id") == F.col("row_id"), F.col("val")))
    c = _beside(m.cells, F.coalesce(own, F.max("val")).alias("_d"))
    return m.put(c.select("col_id", "row_id", (F.col("val") / F.col("_d")).alias("val")))


# ---- selections by rank; every one is an ordered window over the column


def _at_least_as_high() -> Column:
    """How many cells of the column are at least as high as this one."""
    return F.count("*").over(_col().orderBy(F.desc("val")).rangeBetween(W.unboundedPreceding, W.currentRow))


def k_bar(m: Matrix, k: int, largest: bool = True) -> DataFrame:
    """(col_id, val): the k-th largest (or smallest) value of the columns that have so many."""
    o = F.desc("val") if largest else F.asc("val")
    return m.cells.withColumn("_r", F.row_number().over(_col().orderBy(o))).where(F.col("_r") == k).select("col_id", "val")


def top_k(m: Matrix, k: int, ties: str = "drop") -> Matrix:
    """The k largest of every column. Cells tied across the border are all dropped (``drop``), all kept (``keep``), or only what lies strictly above the k-th stays (``above``)."""
    near = m.cells.withColumn("_n", F.rank().over(_col().orderBy(F.desc("val")))).where(F.col("_n") <= k)
    if ties == "keep":
        return m.put(near)
    if ties == "drop":
        return m.put(near.withColumn("_n", _at_least_as_high()).where(F.col("_n") <= k))
    # a column's k-th value is its smallest one left, if it has so many
    kth = near.withColumn("_k", F.min("val").over(_col())).withColumn("_c", F.count("*").over(_col()))
    return m.put(kth.where(f"_c < {int(k)} OR val > _k"))


def knn(m: Matrix, k: int) -> Matrix:
    """Mutual arcs among every node's k largest."""
    return mutual(top_k(m, k))


def quantiles(m: Matrix, q: float) -> Matrix:
    """The largest round(q * degree) of every column, ties at the border dropped."""
    n = F.floor(F.count("*").over(_col()) * q + 0.5)
    return m.put(m.cells.withColumn("_n", _at_least_as_high()).withColumn("_m", n).where("_n <= _m"))


def ssq(m: Matrix, a: float) -> Matrix:
    """Cells above ``a`` times the column's sum of squares over its sum, both without the loop."""
    off = F.when(F.col("col_id") != F.col("row_id"), F.col("val")).otherwise(0.0)
    c = _beside(m.cells, F.sum(off).alias("_t"), F.sum(off * off).alias("_q"))
    return m.put(c.where((F.col("_t") != 0) & (F.col("val") > a * F.col("_q") / F.col("_t"))))


def ranks(cells: DataFrame) -> DataFrame:
    """Values replaced by their average rank within the column, from 1."""
    first = F.rank().over(_col().orderBy("val"))
    peers = F.count("*").over(W.partitionBy("col_id", "val"))
    return cells.select("col_id", "row_id", (first + (peers - 1) / 2.0).alias("val"))


def columns_by_size(m: Matrix, key: str = "size") -> DataFrame:
    """(old, new): columns renumbered from 0 by size (or sum), largest first, then by id."""
    by = F.count("row_id") if key == "size" else F.coalesce(F.sum("val"), F.lit(0.0))
    s = m.cols.join(m.cells, F.col("id") == F.col("col_id"), "left").groupBy("id").agg(by.alias("s"))
    return number(s, [F.desc("s"), F.col("id")], "new").select(F.col("id").alias("old"), "new")


def ceil_neighbours(m: Matrix, most: int) -> Matrix:
    """No node keeps more than ``most`` arcs: nodes are taken by falling original degree, then id; each keeps its largest arcs (ties to the smaller id) and the others go in both directions, which later nodes see.

    Every step depends on the ones before it. Only nodes whose degree is above
    ``most`` take a step and only their arcs matter, so those alone are brought
    together, and the rest of the graph stays where it is. The number of such
    arcs is bounded by the graph's hubs.
    """
    import pandas as pd

    deg = m.cells.groupBy("col_id").agg(F.count("*").alias("d"))
    hubs = deg.where(F.col("d") > most)
    arcs = m.cells.join(hubs.select(F.col("col_id").alias("_h"), "d"), F.col("col_id") == F.col("_h")).select("col_id", "row_id", "val")

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for c, r, v in zip(pdf["col_id"], pdf["row_id"], pdf["val"]):
            near.setdefault(c, {})[r] = v
        gone = []
        for c in sorted(near, key=lambda x: (-len(near[x]), x)):
            own = near[c]
            if len(own) > most:
                for r in sorted(own, key=lambda x: (-own[x], x))[most:]:
                    del own[r]
                    gone.append((c, r))
                    near.get(r, {}).pop(c, None)
        return pd.DataFrame(gone, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})

    cut = arcs.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(go, "a bigint, b bigint")
    both = cut.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(cut.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    return m.put(m.cells.join(both, (F.col("col_id") == F.col("x")) & (F.col("row_id") == F.col("y")), "left_anti"))


def select_columns(m: Matrix, least: int | None = None, most: int | None = None) -> DataFrame:
    """(id): columns whose number of cells lies in the bounds."""
    s = column_stats(m).select(F.col("col_id").alias("id"), "n")
    if least is not None:
        s = s.where(F.col("n") >= least)
    if most is not None:
        s = s.where(F.col("n") <= most)
    return s.select("id")


def median(m: Matrix) -> DataFrame:
    """(col_id, val): the median of each column's cells."""
    return m.cells.groupBy("col_id").agg(F.percentile("val", F.lit(0.5)).alias("val"))

