"""Random graphs and random changes of graphs. Results depend on the seed and on ids only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.matrix import Matrix

_SPAN = 1 << 53


def uniform(seed: int, *cols: str) -> Column:
    """A number in [0, 1) out of the values of some columns; the same on every run and in every task."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(_SPAN)) / float(_SPAN)


def edges(m: Matrix) -> DataFrame:
    """(x, y, val) with x < y."""
    return m.cells.where("col_id < row_id").select(F.col("col_id").alias("x"), F.col("row_id").alias("y"), "val")


def _mirrored(e: DataFrame) -> DataFrame:
    return e.select(F.col("x").alias("col_id"), F.col("y").alias("row_id"), "val").unionByName(e.select(F.col("y").alias("col_id"), F.col("x").alias("row_id"), "val"))


def remove_edges(m: Matrix, n: int, seed: int = 1) -> Matrix:
    """The graph without ``n`` random edges; loops stay."""
    e = edges(m)
    gone = e.withColumn("_u", uniform(seed, "x", "y")).orderBy("_u", "x", "y").limit(n).select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    kept = e.join(gone, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left_anti")
    return m.put(_mirrored(kept).unionByName(m.cells.where("col_id = row_id")))


def weights(kind: str, u: Column, v: Column, low: float, high: float, mean: float, sd: float, skew: float = 1.0) -> Column:
    """Weights from two uniform numbers: ``uniform``, ``normal`` (clamped to the bounds) or ``skew`` (a power of a uniform number)."""
    if kind == "normal":
        z = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * 3.141592653589793 * v)
        return F.least(F.greatest(mean + sd * z, F.lit(low)), F.lit(high))
    return low + (high - low) * (F.pow(u, F.lit(skew)) if kind == "skew" else u)


def add_edges(m: Matrix, n: int, kind: str = "uniform", low: float = 0.0, high: float = 1.0, mean: float = 0.5, sd: float = 0.1, skew: float = 1.0, seed: int = 1) -> Matrix:
    """The graph with ``n`` more random edges between nodes that have none (fewer if the graph is nearly full). Domains must be 0 .. n-1."""
    nodes = m.cols.count()
    spark = m.cells.sparkSession
    tries = spark.range(4 * n + 64).select("id", F.floor(uniform(seed, "id") * nodes).alias("p"), F.floor(uniform(seed + 1, "id") * nodes).alias("q")).where("p <> q")
    new = tries.groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.min("id").alias("id"))
    old = edges(m).select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    new = new.join(old, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left_anti").orderBy("id").limit(n)
    w = new.select("x", "y", weights(kind, uniform(seed + 2, "id"), uniform(seed + 3, "id"), low, high, mean, sd, skew).alias("val"))
    return m.put(m.cells.unionByName(_mirrored(w)))


def generate(spark: SparkSession, nodes: int, n: int, seed: int = 1, **kind) -> Matrix:
    """A random graph on 0 .. nodes-1 with ``n`` edges."""
    dom = spark.range(nodes)
    empty = spark.createDataFrame([], "col_id bigint, row_id bigint, val double")
    return add_edges(Matrix(empty, dom, dom), n, seed=seed, **kind)


def noise(m: Matrix, sd: float, seed: int = 1) -> Matrix:
    """Weights with normal noise added, the same for both directions of an edge."""
    lo, hi = F.least("col_id", "row_id"), F.greatest("col_id", "row_id")
    c = m.cells.withColumn("_a", lo).withColumn("_b", hi)
    z = weights("normal", uniform(seed, "_a", "_b"), uniform(seed + 1, "_a", "_b"), -1e300, 1e300, 0.0, sd)
    return m.put(c.withColumn("val", F.col("val") + z))


def swap_edges(m: Matrix, rounds: int = 1, seed: int = 1) -> Matrix:
    """Degree-preserving shuffle: each round pairs the edges at random and exchanges the far ends of every pair, unless that would give a loop or an edge that exists or is made twice.

    All pairs of a round exchange at once, so rounds replace a long row of
    single swaps. Weights stay with the first end.
    """
    from gridloom.plans.materialize import materialize, release

    e = materialize(edges(m))
    for r in range(rounds):
        # neighbours in hash order are pairs; each edge is in one pair of its bucket
        h = e.withColumn("_h", F.xxhash64(F.lit(seed + r), "x", "y"))
        n = max(1, e.count() // 2)
        h = h.withColumn("_p", F.pmod("_h", F.lit(n)))
        from pyspark.sql import Window as W

        h = h.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy("_h", "x", "y")))
        a = h.where("_i = 1").select("_p", F.col("x").alias("a"), F.col("y").alias("b"), F.col("val").alias("v"))
        b = h.where("_i = 2").select(F.col("_p").alias("_q"), F.col("x").alias("c"), F.col("y").alias("d"), F.col("val").alias("w"))
        s = a.join(b, F.col("_p") == F.col("_q")).where("a <> d AND c <> b AND a <> c AND b <> d")
        two = s.select("_p", "a", "b", "c", "d", F.explode(F.array(F.struct(F.least("a", "d").alias("x"), F.greatest("a", "d").alias("y"), F.col("v").alias("val")), F.struct(F.least("c", "b").alias("x"), F.greatest("c", "b").alias("y"), F.col("w").alias("val")))).alias("n")).select("_p", "a", "b", "c", "d", "n.*")
        old = e.select(F.col("x").alias("_x"), F.col("y").alias("_y"))
        ok = two.join(old, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left_anti")
        ok = ok.withColumn("_m", F.count("*").over(W.partitionBy("x", "y"))).where("_m = 1")
        ok = materialize(ok.withColumn("_k", F.count("*").over(W.partitionBy("_p"))).where("_k = 2").select("a", "b", "c", "d", "x", "y", "val"))
        gone = ok.select(F.explode(F.array(F.struct(F.least("a", "b").alias("gx"), F.greatest("a", "b").alias("gy")), F.struct(F.least("c", "d").alias("gx"), F.greatest("c", "d").alias("gy")))).alias("g")).select("g.*").distinct()
        nxt = materialize(e.join(gone, (F.col("x") == F.col("gx")) & (F.col("y") == F.col("gy")), "left_anti").unionByName(ok.select("x", "y", "val")))
        release(m.cells.sparkSession, e, ok)
        e = nxt
    return m.put(_mirrored(e).unionByName(m.cells.where("col_id = row_id")))
