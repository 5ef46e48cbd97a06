"""Functions of two weights, for joins, symmetrisation and repeated cells. A missing side is 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Merge = Callable[[Column, Column], Column]


def _both(f: Merge) -> Merge:
    return lambda l, r: F.when((l != 0) & (r != 0), f(l, r)).otherwise(0.0)


MERGES: dict[str, Merge] = {
    "left": lambda l, r: l,
    "right": lambda l, r: r,
    "add": lambda l, r: l + r,
    "sub": lambda l, r: l - r,
    "mul": lambda l, r: l * r,
    "cross": lambda l, r: F.when((l != 0) & (r != 0), l * r).otherwise(l + r),
    "min": lambda l, r: F.least(l, r),
    "max": lambda l, r: F.greatest(l, r),
    "minnz": _both(lambda l, r: F.least(l, r)),
    "maxnz": _both(lambda l, r: F.greatest(l, r)),
    "or": lambda l, r: F.when(l != 0, l).otherwise(r),
    "and_not": lambda l, r: F.when(r == 0, l).otherwise(0.0),
    "and": lambda l, r: F.when(r != 0, l).otherwise(0.0),
    "arcmax": lambda l, r: F.when((l != 0) & (r != 0), F.when(l >= r, l).otherwise(0.0)).otherwise(l),
    "arcsub": lambda l, r: l - r,
    "zero": lambda l, r: F.lit(0.0),
    "half": lambda l, r: F.lit(0.5),
    "one": lambda l, r: F.lit(1.0),
    "one_and_half": lambda l, r: F.lit(1.5),
}

_CMP: dict[str, Callable[[Column, float], Column]] = {"gq": lambda x, a: x >= a, "gt": lambda x, a: x > a, "lq": lambda x, a: x <= a, "lt": lambda x, a: x < a}


def arc_filter(kind: str, cmp: str, a: float) -> Merge:
    """Keeps the left arc by a test of it and its reverse: ``max`` if either passes, ``min`` if both do, ``diff`` if either difference passes."""
    test = _CMP[cmp]

    def f(l: Column, r: Column) -> Column:
        if kind == "max":
            keep = test(l, a) | test(r, a)
        elif kind == "min":
            keep = test(l, a) & test(r, a)
        else:
            keep = test(l - r, a) | test(r - l, a)
        return F.when(keep, l).otherwise(0.0)

    return f


#: How repeated cells become one; ``first`` and ``last`` need a position.
REPEATS = {
    "max": lambda v, p: F.max(v),
    "min": lambda v, p: F.min(v),
    "add": lambda v, p: F.sum(v),
    "mul": lambda v, p: F.product(v),
    "first": lambda v, p: F.min_by(v, p),
    "last": lambda v, p: F.max_by(v, p),
}
