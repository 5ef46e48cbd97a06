"""Consolidating pairwise matches into groups: hash-to-min.

Each vertex v holds a cluster C(v), at first its neighbours. A round finds the
minimum m of v and C(v), sends C(v) to m and m to every member. What is sent
is sent both ways, so clusters are symmetric and a state is a set of unordered
pairs (a, b), a < b, each kept once. The cluster of a minimum that gathers a
third of all records is spread over the shuffle and never one value.

A vertex whose cluster is a single smaller vertex can no longer be anybody's
minimum: it is retired with a pointer to that vertex, and its pair takes part
in no further round. Settled components, which are stars around their minimum,
thus leave the state at once, and a round costs what still moves. The pointers
form a forest no deeper than the number of rounds and are resolved by jumping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.lookup import heavy_bar, heavy_lookup_join
from gridloom.plans.materialize import counted, materialize, release, sweep

MAX_ROUNDS = 100


def _pair(p: str, q: str):
    return F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.lit(False).alias("done"))


def hash_to_min(links: DataFrame) -> DataFrame:
    """(node, group_label): the smallest node linked directly or indirectly, for every node of ``links`` (x, y).

    Nodes compare as Spark orders their type: strings by bytes. Links with a
    null end are left out, links of a node with itself put the node into a
    group of its own, no links give no rows.
    """
    ends = links.where("x IS NOT NULL AND y IS NOT NULL").select(F.explode(F.array("x", "y")).alias("node"))
    return _labelled(ends.distinct(), links)


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    top = pointers(links)
    out = nodes.join(top.select(F.col("node").alias("_n"), "up"), F.col("node") == F.col("_n"), "left")
    return out.select("node", F.coalesce("up", "node").alias("group_label"))


def pointers(links: DataFrame) -> DataFrame:
    """(node, up): every node that is not the smallest of its group, with the one that is."""
    spark = links.sparkSession
    e = links.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    state, n = counted(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n=F.count(F.lit(1)))
    up = state.select(F.col("b").alias("node"), F.col("a").alias("up")).limit(0)
    rounds = 0
    while n["n"]:
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"not stable after {MAX_ROUNDS} rounds")
        rounds += 1
        low = _minima(state)
        after, n = counted(_round(state, low, n["n"]), by="done", n=F.count_if(~F.col("done")))
        release(spark, state, low)
        state, gone = after.where("NOT done").select("a", "b"), after.where("done").select(F.col("b").alias("node"), F.col("a").alias("up"))
        state._gridloom_path = after._gridloom_path + "/done=false"
        up = gone if rounds == 1 else up.unionByName(gone)
        sweep(spark)
    return _resolve(up) if rounds else up


def _minima(state: DataFrame) -> DataFrame:
    """(v, m, n): each vertex with the smallest of itself and its cluster, and the cluster's size."""
    both = state.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("p")).select("p.*")
    return materialize(both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).select("v", F.least("m", "v").alias("m"), "n"))


def _round(state: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """(a, b, done): the pairs sent in a round and, done, the vertices b retired to a."""
    la, lb = (low.select(F.col("v").alias(f"v{i}"), F.col("m").alias(f"m{i}"), F.col("n").alias(f"n{i}")) for i in "ab")
    if low.where(F.col("n") >= heavy_bar(2 * n)).isEmpty():
        known = state.join(la, F.col("a") == F.col("va")).join(lb, F.col("b") == F.col("vb"))
    else:
        known = heavy_lookup_join(heavy_lookup_join(state, la.withColumnRenamed("va", "a"), "a", "na", 2 * n), lb.withColumnRenamed("vb", "b"), "b", "nb", 2 * n)
    retired = F.array(F.struct("a", "b", F.lit(True).alias("done")))
    sent = known.select(F.explode(F.when(F.col("nb") == 1, retired).otherwise(F.array(_pair("ma", "b"), _pair("mb", "a")))).alias("p")).select("p.*")
    return sent.where("a <> b").distinct()


def _resolve(up: DataFrame) -> DataFrame:
    """(node, up) with ``up`` moved to the end of its pointers."""
    spark = up.sparkSession
    up = materialize(up)
    for _ in range(MAX_ROUNDS):
        step = up.select(F.col("node").alias("n2"), F.col("up").alias("u2"))
        moved = F.col("u2").isNotNull()
        after, n = counted(up.join(step, F.col("up") == F.col("n2"), "left").select("node", F.coalesce("u2", "up").alias("up"), moved.alias("moved")), n=F.count_if(F.col("moved")))
        release(spark, up)
        up = after.select("node", "up")
        up._gridloom_path = after._gridloom_path
        if not n["n"]:
            return up
    raise RuntimeError("pointers do not end")


def linked(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of tree_pairs that link: both records present and ``val`` at least ``least``; a null or NaN ``val`` does not."""
    return pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("val").isNotNull() & ~F.isnan("val") & (F.col("val") >= least)).select("x", "y")


def group_records(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(label, group_label) of every distinct non-null ``x`` or ``y``; a record without links is its own group."""
    records = pairs.select(F.explode(F.array("x", "y")).alias("label")).where("label IS NOT NULL").distinct()
    return _labelled(records.withColumnRenamed("label", "node"), linked(pairs, least)).withColumnRenamed("node", "label")
