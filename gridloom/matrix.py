"""The sparse matrix with explicit domains that every operator takes and gives.

``cells`` has a row (col_id, row_id, val) for each cell that is not zero,
``cols`` and ``rows`` have the ids of the domains, which may hold ids without
cells. A graph has equal domains; the column is the tail of an arc. A
clustering has clusters as columns and nodes as rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["col_id", "row_id", "val"]


def cells_of(df: DataFrame, col: str = "col_id", row: str = "row_id", val: str | Column = "val") -> DataFrame:
    """Cells out of any table: ids as bigint, values as double, rows with a null part and zeros left out."""
    v = (F.col(val) if isinstance(val, str) else val).cast("double")
    out = df.select(F.col(col).cast("bigint").alias("col_id"), F.col(row).cast("bigint").alias("row_id"), v.alias("val"))
    return out.where("col_id IS NOT NULL AND row_id IS NOT NULL AND val IS NOT NULL AND val <> 0")


def domain(df: DataFrame, *columns: str) -> DataFrame:
    """(id): the distinct non-null values of the columns."""
    one = df.select(F.explode(F.array(*[F.col(c).cast("bigint") for c in columns])).alias("id")) if len(columns) > 1 else df.select(F.col(columns[0]).cast("bigint").alias("id"))
    return one.where("id IS NOT NULL").distinct()


@dataclass(frozen=True)
class Matrix:
    cells: DataFrame
    cols: DataFrame
    rows: DataFrame

    @classmethod
    def graph(cls, cells: DataFrame, nodes: DataFrame | None = None) -> Matrix:
        """Square over ``nodes`` (id), by default over the ids of the cells; cells outside the domain are dropped."""
        if nodes is None:
            nodes = domain(cells, "col_id", "row_id")
            return cls(cells, nodes, nodes)
        return cls(within(cells, nodes, nodes), nodes, nodes)

    @classmethod
    def of(cls, cells: DataFrame, cols: DataFrame | None = None, rows: DataFrame | None = None) -> Matrix:
        return cls(cells, domain(cells, "col_id") if cols is None else cols, domain(cells, "row_id") if rows is None else rows)

    def put(self, cells: DataFrame) -> Matrix:
        """The same domains with other cells; zeros vanish."""
        return replace(self, cells=cells.select(*CELL).where("val <> 0"))

    @property
    def t(self) -> Matrix:
        """Transpose: names change, no row moves."""
        return Matrix(self.cells.select(F.col("row_id").alias("col_id"), F.col("col_id").alias("row_id"), "val"), self.rows, self.cols)


def within(cells: DataFrame, cols: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Cells whose ids lie in the domains given; the planner broadcasts a domain only where it is small."""
    if cols is not None:
        cells = cells.join(cols.select(F.col("id").alias("_c")), F.col("col_id") == F.col("_c"), "left_semi")
    if rows is not None:
        cells = cells.join(rows.select(F.col("id").alias("_r")), F.col("row_id") == F.col("_r"), "left_semi")
    return cells


def is_graph(m: Matrix) -> bool:
    return m.cols.exceptAll(m.rows).isEmpty() and m.rows.exceptAll(m.cols).isEmpty()


def is_canonical(dom: DataFrame) -> bool:
    """Whether the ids are 0 .. n-1."""
    r = dom.agg(F.count("*").alias("n"), F.max("id").alias("m"), F.min("id").alias("l")).first()
    return r.n == 0 or (r.m == r.n - 1 and r.l == 0)


def range_domain(spark, n: int, start: int = 0) -> DataFrame:
    return spark.range(start, start + n)
