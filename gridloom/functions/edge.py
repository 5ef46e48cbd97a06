"""Functions of one edge weight. A weight that becomes 0 removes its cell."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.matrix import CELL, Matrix

# fixed value: the largest single-precision number, which stands for the logarithm of 0
FLT_MAX = 3.4028234663852886e38

Op = Callable[[Column], Column]


def _keep(test: Callable[[Column], Column]) -> Op:
    return lambda v: F.when(test(v), v).otherwise(0.0)


def _log(base: float | None) -> Op:
    def f(v: Column) -> Column:
        ln = F.log(v) if not base else F.log(v) / F.log(F.lit(float(base)))
        return F.when(v > 0, ln).when(v == 0, -FLT_MAX).otherwise(0.0)

    return f


def gq(a: float) -> Op:
    return _keep(lambda v: v >= a)


def gt(a: float) -> Op:
    return _keep(lambda v: v > a)


def lq(a: float) -> Op:
    return _keep(lambda v: v <= a)


def lt(a: float) -> Op:
    return _keep(lambda v: v < a)


def const(a: float) -> Op:
    return lambda v: F.lit(float(a))


def copy() -> Op:
    return lambda v: v


def scale(a: float) -> Op:
    """Divides; by 0 gives 0."""
    return lambda v: v / a if a else F.lit(0.0)


def mul(a: float) -> Op:
    return lambda v: v * a


def add(a: float) -> Op:
    return lambda v: v + a


def power(a: float) -> Op:
    return lambda v: F.pow(v, F.lit(float(a)))


def exp(base: float | None = None) -> Op:
    return lambda v: F.pow(F.lit(float(base)), v) if base else F.exp(v)


def log(base: float | None = None) -> Op:
    """Natural without a base; of 0 the lowest number, of negative weights 0."""
    return _log(base)


def neglog(base: float | None = None) -> Op:
    return lambda v: -_log(base)(v)


def absolute() -> Op:
    return lambda v: F.abs(v)


def ceil(a: float) -> Op:
    """Clamps from above; no rounding."""
    return lambda v: F.least(v, F.lit(float(a)))


def floor(a: float) -> Op:
    """Clamps from below; no rounding."""
    return lambda v: F.greatest(v, F.lit(float(a)))


def rand(p: float, seed: int = 1) -> Op:
    """Keeps a weight with probability ``p``."""
    return lambda v: F.when(F.rand(seed) <= p, v).otherwise(0.0)


OPS: dict[str, Callable[..., Op]] = {
    "gq": gq, "gt": gt, "lt": lt, "lq": lq, "rand": rand, "mul": mul, "scale": scale, "add": add, "abs": absolute, "ceil": ceil, "floor": floor,
    "pow": power, "power": power, "exp": exp, "log": log, "neglog": neglog, "const": const,
}


def apply_cells(cells: DataFrame, ops: list[Op]) -> DataFrame:
    """The functions in order, as one projection; a weight that is 0 after any step is gone for the later ones."""

    def step(v: Column, op: Op) -> Column:
        return F.when(v != 0, op(v)).otherwise(0.0)

    v = reduce(step, ops[1:], ops[0](F.col("val"))) if ops else F.col("val")
    return cells.select("col_id", "row_id", v.alias("val")).where("val <> 0").select(*CELL)


def unary(m: Matrix, *ops: Op) -> Matrix:
    return m.put(apply_cells(m.cells, list(ops)))


def select_values(m: Matrix, low: float | None = None, high: float | None = None, strict_low: bool = False, strict_high: bool = False) -> Matrix:
    """Cells with a weight in the range, inclusive unless strict."""
    c = m.cells
    if low is not None:
        c = c.where(F.col("val") > low if strict_low else F.col("val") >= low)
    if high is not None:
        c = c.where(F.col("val") < high if strict_high else F.col("val") <= high)
    return m.put(c)


def select_ids(m: Matrix, low: int | None = None, high: int | None = None) -> Matrix:
    """Cells with a row id in the inclusive range; reaches the scan as a filter."""
    c = m.cells
    if low is not None:
        c = c.where(F.col("row_id") >= low)
    if high is not None:
        c = c.where(F.col("row_id") <= high)
    return m.put(c)
