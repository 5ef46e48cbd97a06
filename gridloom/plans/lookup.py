"""Joining a small per-key fact to rows whose keys are skewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No more than this many keys are ever broadcast, and none of fewer rows, which no task would notice.
HEAVY_KEYS = 4096
HEAVY_ROWS = 8192


def heavy_bar(total: int) -> int:
    """Rows from which one of ``total`` rows' keys is heavy."""
    return max(HEAVY_ROWS, -(-total // HEAVY_KEYS))


def heavy_lookup_join(rows: DataFrame, counts: DataFrame, key: str, n_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``counts`` (one row a key, ``n_col`` = rows of the key).

    Keys holding at least ``total / HEAVY_KEYS`` rows and HEAVY_ROWS are at most
    HEAVY_KEYS by arithmetic, so that part is broadcast whatever the table's size; no other key
    is heavy enough to unbalance the shuffle that the remaining rows take. A
    null key matches nothing.
    """
    bar = heavy_bar(total)
    heavy = counts.where(F.col(n_col) >= bar)
    light = counts.where(F.col(n_col) < bar)
    marked = rows.join(F.broadcast(heavy.select(F.col(key).alias("_hk"), F.struct(*[c for c in counts.columns if c != key]).alias("_hv"))), F.col(key) == F.col("_hk"), "left")
    facts = [c for c in counts.columns if c != key]
    hot = marked.where(F.col("_hk").isNotNull()).select(*rows.columns, *[F.col(f"_hv.{c}").alias(c) for c in facts])
    cold = marked.where(F.col("_hk").isNull()).select(*rows.columns).join(light.withColumnRenamed(key, "_lk"), F.col(key) == F.col("_lk")).select(*rows.columns, *facts)
    return hot.unionByName(cold)


def bucket_of(n: int, *cols: Column) -> Column:
    """A bucket number in 0..n-1 that depends on the values only, so a task run again puts every row where it was."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
