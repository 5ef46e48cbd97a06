"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows get a bucket from their own values, so (key, bucket) is the unit that is
shuffled and never the key alone. Counting rows per (key, bucket) and
prefix-summing the counts over a key's buckets gives every bucket its exact
offset; offset plus the row number inside the bucket numbers a key's rows
without ever bringing them together. Equal-sized runs of that number are the
chunks. Each chunk is reduced to a small state, and only states meet per key,
merged in chunk order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.plans.lookup import bucket_of

CHUNK_ROWS = 65536
#: Rows a bucket of a crowded key should hold; the number of buckets follows the largest key, within these bounds.
BUCKET_ROWS = 1 << 20
BUCKETS = 64
BUCKETS_MOST = 1024
#: Keys on at least one in so many rows are spread over buckets; there are no more such keys than this.
SPREAD = 1024


def range_bounds(df: DataFrame, order: str, buckets: int = BUCKETS) -> list:
    """At most ``buckets - 1`` ascending cut points of ``order`` over all rows."""
    row = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10000).alias("q")).first()
    return sorted(set(row.q or []))


def _range_bucket(order: str, bounds: list, start: int = 0) -> Column:
    """The number of ``bounds`` below ``order``, by halving."""
    if not bounds:
        return F.lit(start)
    mid = len(bounds) // 2
    return F.when(F.col(order) <= F.lit(bounds[mid]), _range_bucket(order, bounds[:mid], start)).otherwise(_range_bucket(order, bounds[mid + 1 :], start + mid + 1))


def buckets_for(rows: int) -> int:
    """Buckets for keys of up to so many rows."""
    return max(BUCKETS, min(BUCKETS_MOST, -(-rows // BUCKET_ROWS)))


def number_rows(df: DataFrame, key: str, order: str, chunk_rows: int = CHUNK_ROWS, buckets: int = BUCKETS, bounds: list | None = None, merge: list[Column] | None = None, crowded: list | None = None) -> DataFrame:
    """Add ``pos`` (1, 2, ... within the key), ``chunk`` (``(pos - 1) // chunk_rows``), ``total`` (the key's number of rows), ``bucket``, and ``prev`` (``order`` of the row before in its bucket).

    ``order`` must be unique and not null within a key. With ``bounds`` (see
    ``range_bounds``) positions follow ``order``; without, buckets are hashed
    and positions are some fixed numbering. The key's own rows with a null key
    are numbered as one key. An empty table gives an empty result. ``merge``:
    aggregates that first make one row of those with the same key and order,
    inside the same shuffle. ``crowded``: the keys that are spread over buckets,
    by default all; a key that cannot unbalance a shuffle is better left whole.
    """
    at = bucket_of(buckets, F.col(order)) if bounds is None else _range_bucket(order, bounds)
    if crowded is not None:
        at = F.when(F.col(key).isin(crowded), at).otherwise(0) if crowded else F.lit(0)
    parts = df.withColumn("_b", at).repartition(F.col(key), F.col("_b"))
    if merge:
        parts = parts.groupBy(key, "_b", order).agg(*merge)
    cols = [c for c in parts.columns if c != "_b"]
    counts = parts.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(W.partitionBy(key)).alias("total"))
    run = W.partitionBy(key, "_b").orderBy(order)
    inside = parts.withColumn("_rn", F.row_number().over(run)).withColumn("prev", F.lag(order).over(run))
    out = inside.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    pos = F.col("_rn") + F.col("_off")
    return out.select(*cols, pos.alias("pos"), F.floor((pos - 1) / chunk_rows).cast("long").alias("chunk"), "total", F.col("_b").alias("bucket"), "prev")


def largest() -> list[Column]:
    """Repeated cells count once, with their largest value."""
    return [F.max("val").alias("val")]


def whole_cells(cells: DataFrame) -> DataFrame:
    """(col_id, row_id, val) without rows that have a null or NaN part; repeats stay."""
    c = cells.select("col_id", "row_id", F.col("val").cast("double").alias("val"))
    return c.where(F.col("col_id").isNotNull() & F.col("row_id").isNotNull() & F.col("val").isNotNull() & ~F.isnan("val"))


def crowded_keys(df: DataFrame, key: str, one_in: int) -> dict:
    """The keys on at least one in ``one_in`` of all rows as stored, with their numbers of rows; null is no key. There are at most ``one_in`` of them.

    Counts are made per input partition (the map side of the aggregation) and
    only those counts are shuffled.
    """
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).first().t or 0
    bar = -(-total // one_in)
    return {r.k: r.n for r in counts.where(F.col("k").isNotNull() & (F.col("n") >= max(bar, 1))).orderBy("k").collect()}


def crowded_top_rows(cells: DataFrame, one_in: int = 80, k: int = 10, chunk_rows: int = CHUNK_ROWS, buckets: int | None = None) -> DataFrame:
    """(col_id, row_id, val, rank): the ``k`` largest cells of each crowded column, ties to the smaller row id.

    Each equal-sized chunk of a column keeps its own best ``k``; the merged
    states are ranked per column. Nulls, NaN, repeats, an empty table and extra
    columns behave as in ``whole_cells`` and ``crowded_keys``.
    """
    counts = crowded_keys(cells, "col_id", one_in)
    hot, buckets = list(counts), buckets or buckets_for(max(counts.values(), default=0))
    rows = whole_cells(cells.where(F.col("col_id").isin(hot) if hot else F.lit(False)))
    numbered = number_rows(rows, "col_id", "row_id", chunk_rows, buckets, merge=largest(), crowded=hot)
    best = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("val"), F.asc("row_id")))
    states = numbered.withColumn("_r", best("col_id", "chunk")).where(F.col("_r") <= k)
    return states.withColumn("rank", best("col_id")).where(F.col("rank") <= k).select("col_id", "row_id", "val", "rank")


def column_profile(cells: DataFrame, chunk_rows: int = CHUNK_ROWS, buckets: int | None = None) -> DataFrame:
    """Per column over its rows in ascending order: ``n_cells``, ``max_val``, ``first_row``, ``last_row``, ``widest_gap``, ``median_row``.

    ``widest_gap`` is the largest difference of neighbouring row ids (0 for one
    cell); ``median_row`` is the lower middle row. Gaps inside a chunk are part
    of its state; the gap between two chunks comes from the boundary states
    (last row of one, first row of the next) merged in order.
    """
    counts = crowded_keys(cells, "col_id", SPREAD)
    crowded, buckets = list(counts), buckets or buckets_for(max(counts.values(), default=0))
    numbered = number_rows(whole_cells(cells), "col_id", "row_id", chunk_rows, buckets, range_bounds(cells, "row_id", buckets), largest(), crowded)
    # states are kept per bucket, too: rows stay where they were numbered, and a bucket's seam is a chunk's
    gap = F.when(F.col("prev").isNotNull(), F.col("row_id") - F.col("prev"))
    middle = F.when(F.col("pos") == F.floor((F.col("total") + 1) / 2), F.col("row_id"))
    states = numbered.withColumn("_g", gap).groupBy("col_id", "bucket", "chunk").agg(
        F.count("*").alias("n"), F.max("val").alias("mx"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.max("_g").alias("g"), F.max(middle).alias("mid")
    )
    seam = F.col("lo") - F.lag("hi").over(W.partitionBy("col_id").orderBy("chunk", "bucket"))
    return states.withColumn("seam", seam).groupBy("col_id").agg(
        F.sum("n").alias("n_cells"), F.max("mx").alias("max_val"), F.min("lo").alias("first_row"), F.max("hi").alias("last_row"),
        F.coalesce(F.max(F.greatest("g", "seam")), F.lit(0)).alias("widest_gap"), F.max("mid").alias("median_row"),
    )
