"""Grouping records into similarity clusters: average linkage by reciprocal nearest neighbours.

The graph is sparse: pairs below ``SIMILAR`` have no edge and count as 0 in an
average. A node is a class of identical sets with its number of copies as
weight. Each round every cluster finds its best neighbour, all mutual best
pairs merge at once and the sums of similarity over member pairs are added up,
until no average reaches the threshold. Ties are broken by a hash of the pair
that both ends see alike, so a clique of ties merges in a few rounds and not
one pair at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm import setjoin
from gridloom.matrix import Matrix
from gridloom.operators.graphs import components
from gridloom.plans.materialize import materialize, release, sweep

#: Pairs of columns less similar than this have no edge; groups of problem 4 have at least 0.45 inside and less than 0.3 outside.
SIMILAR = Fraction(2, 5)
MAX_ROUNDS = 200
#: Components of more edges than this are merged by rounds of jobs, all others whole within tasks.
LOCAL_EDGES = 200_000


def cluster(nodes: DataFrame, edges: DataFrame, stop: float) -> DataFrame:
    """(node, cluster) of ``nodes`` (node, w) under ``edges`` (a, b, sim), a < b, each pair once.

    Clusters are named by their smallest node. Nodes without edges stay alone;
    an edge of null or NaN similarity is none; empty tables give an empty
    result.
    """
    w1, w2 = (nodes.select(F.col("node").alias(f"n{i}"), F.col("w").cast("double").alias(f"w{i}")) for i in "ab")
    live = edges.where("sim IS NOT NULL AND NOT isnan(sim)").join(w1, F.col("a") == F.col("na")).join(w2, F.col("b") == F.col("nb"))
    live = materialize(live.select("a", "b", "wa", "wb", (F.col("sim") * F.col("wa") * F.col("wb")).alias("s")))
    # clusters never merge across the components of the graph, so each component is its own task's work unless it is too large for one
    graph = Matrix.graph(live.select(F.col("a").alias("col_id"), F.col("b").alias("row_id"), F.col("s").alias("val")))
    of = materialize(components(graph).select("component", F.col("node").alias("_n")))
    placed = live.join(of, F.col("a") == F.col("_n")).drop("_n")
    giants = placed.groupBy(F.col("component").alias("_g")).agg(F.count("*").alias("n")).where(F.col("n") > LOCAL_EDGES).select("_g")
    giants = materialize(giants)
    small = placed if giants.isEmpty() else placed.join(giants, F.col("component") == F.col("_g"), "left_anti")
    up = small.repartition("component").sortWithinPartitions("component").mapInPandas(_whole_components(stop), "old bigint, new bigint")
    if not giants.isEmpty():
        rest = placed.join(giants, F.col("component") == F.col("_g"), "left_semi").drop("component")
        up = up.unionByName(_in_rounds(materialize(rest), stop))
    return nodes.join(up, F.col("node") == F.col("old"), "left").select("node", F.coalesce("new", "node").alias("cluster"))


#: Averages are compared in steps of 2^-40, so that sums added in another order are equal.
STEPS = float(1 << 40)


def _tie(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``F.xxhash64(a, b)`` of bigints, so that both versions break ties alike."""
    u = np.uint64
    # fixed values: the public hash's primes
    p1, p2, p3, p4, p5 = u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9), u(0x85EBCA77C2B2AE63), u(0x27D4EB2F165667C5)
    turn = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    h = np.full(len(a), 42, dtype=np.uint64)
    for x in (a, b):
        h = h + p5 + u(8)
        h = turn(h ^ (turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        h = h ^ (h >> u(32))
    return h.view(np.int64)


def merge_rounds(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, s: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cluster of each): rounds of mutual best merges over edges held in memory; clusters keep their smallest id."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, m = len(ids), len(a)
    a, b = ends[:m], ends[m:]
    w = np.zeros(n)
    w[a], w[b] = wa, wb
    root = np.arange(n)
    with np.errstate(over="ignore"):
        while len(a):
            q = np.floor(s / (w[a] * w[b]) * STEPS + 0.5)
            good = np.flatnonzero(q >= np.floor(stop * STEPS + 0.5))
            if not len(good):
                break
            ga, gb = ids[a[good]], ids[b[good]]
            rank = good[np.lexsort((gb, ga, _tie(ga, gb), q[good]))]
            best = np.full(n, -1)
            best[np.stack([a[rank], b[rank]], 1).ravel()] = np.repeat(rank, 2)  # the last one written is the best
            both = good[(best[a[good]] == good) & (best[b[good]] == good)]
            w[a[both]] += w[b[both]]
            to = np.arange(n)
            to[b[both]] = a[both]
            root = to[root]
            x, y = to[a], to[b]
            keep = x != y
            x, y, s = x[keep], y[keep], s[keep]
            key = np.minimum(x, y) * n + np.maximum(x, y)
            order = np.argsort(key, kind="stable")
            key, s = key[order], s[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], int)
            s = np.add.reduceat(s, first) if len(first) else s
            a, b = key[first] // n, key[first] % n
    return ids, ids[root]


def _whole_components(stop: float):
    """Runs ``merge_rounds`` over sorted edges, a few whole components at a time."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def flush(df: pd.DataFrame) -> pd.DataFrame:
            ids, to = merge_rounds(*(df[c].to_numpy() for c in ("a", "b", "wa", "wb", "s")), stop)
            moved = ids != to
            return pd.DataFrame({"old": ids[moved], "new": to[moved]})

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            size += len(pdf)
            if size > LOCAL_EDGES:
                df = pd.concat(held)
                open_ = df["component"] == df["component"].iloc[-1]  # the last component may go on
                if not open_.all():
                    yield flush(df[~open_])
                    df = df[open_]
                held, size = [df], len(df)
        if held:
            yield flush(pd.concat(held))

    return go


def _in_rounds(live: DataFrame, stop: float) -> DataFrame:
    """(old, new) of nodes that change their cluster: the same rounds, each a few jobs over all edges."""
    spark = live.sparkSession
    merges = []
    while len(merges) < MAX_ROUNDS:
        # an edge below the threshold takes no part, it only weighs in later sums
        mean = F.floor(F.col("s") / (F.col("wa") * F.col("wb")) * F.lit(STEPS) + F.lit(0.5))
        good = live.withColumn("q", mean).where(F.col("q") >= F.floor(F.lit(stop) * F.lit(STEPS) + F.lit(0.5)))
        rank = F.struct("q", F.xxhash64("a", "b").alias("h"), "a", "b", (F.col("wa") + F.col("wb")).alias("w"))
        best = good.select(F.explode(F.array("a", "b")).alias("c"), rank.alias("r")).groupBy("c").agg(F.max("r").alias("r"))
        mutual = best.groupBy(F.col("r.a").alias("keep"), F.col("r.b").alias("gone")).agg(F.count("*").alias("n"), F.max("r.w").alias("w"))
        merged = materialize(mutual.where("n = 2").select("keep", "gone", "w"))
        if merged.isEmpty():
            break
        merges.append(merged)
        to = merged.select(F.explode(F.array("keep", "gone")).alias("old"), F.col("keep").alias("new"), F.col("w").alias("nw"))
        ta, tb = (to.select(F.col("old").alias(f"o{i}"), F.col("new").alias(f"t{i}"), F.col("nw").alias(f"nw{i}")) for i in "ab")
        x = live.join(ta, F.col("a") == F.col("oa"), "left").join(tb, F.col("b") == F.col("ob"), "left")
        x = x.select(F.coalesce("ta", "a").alias("p"), F.coalesce("nwa", "wa").alias("wp"), F.coalesce("tb", "b").alias("q"), F.coalesce("nwb", "wb").alias("wq"), "s").where("p <> q")
        ends = lambda i, j: F.when(F.col("p") < F.col("q"), F.col(i)).otherwise(F.col(j))
        x = x.select(ends("p", "q").alias("a"), ends("q", "p").alias("b"), ends("wp", "wq").alias("wa"), ends("wq", "wp").alias("wb"), "s")
        after = materialize(x.groupBy("a", "b", "wa", "wb").agg(F.sum("s").alias("s")))
        release(spark, live)
        live = after
        sweep(spark)
    else:
        raise RuntimeError(f"clusters still merge after {MAX_ROUNDS} rounds")
    if not merges:
        return spark.createDataFrame([], "old bigint, new bigint")
    # a node is merged away once at most: the merges are a forest no deeper than their rounds, resolved by pointer jumping
    up = merges[0]
    for m in merges[1:]:
        up = up.unionByName(m)
    up = up.select(F.col("gone").alias("old"), F.col("keep").alias("new"))
    for _ in range((len(merges) - 1).bit_length()):
        up = materialize(up)
        up = up.join(up.select(F.col("old").alias("o2"), F.col("new").alias("n2")), F.col("new") == F.col("o2"), "left").select("old", F.coalesce("n2", "new").alias("new"))
    return up


def column_rows(cells: DataFrame, coldom: DataFrame) -> DataFrame:
    """(id, tok): the cells that count of the columns of coldom, null, NaN and zero left out."""
    kept = cells.where("col_id IS NOT NULL AND row_id IS NOT NULL AND val IS NOT NULL AND NOT isnan(val) AND val <> 0")
    return kept.select(F.col("col_id").alias("id"), F.col("row_id").alias("tok"))


def similar_columns(cells: DataFrame, coldom: DataFrame, similar: Fraction = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership, members, edges): (node, cluster) of the columns that resemble another, the copies' classes, and the graph."""
    pairs, members, _ = setjoin.set_join(column_rows(cells, coldom), similar)
    edges = materialize(pairs.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("sim")))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    nodes = ends.join(copies, F.col("node") == F.col("rep"), "full").select(F.coalesce("node", "rep").alias("node"), F.coalesce("copies", F.lit(1)).alias("w"))
    return cluster(nodes, edges, float(similar)), members, edges


def group_of(cells: DataFrame, coldom: DataFrame, similar: Fraction = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((col_id, group_id) of the columns with company, members, edges); the group is named by its smallest column."""
    clusters, members, edges = similar_columns(cells, coldom, similar)
    clusters = materialize(clusters)
    spread = clusters.join(members, F.col("node") == F.col("rep"), "left").select(F.coalesce("id", "node").alias("col_id"), F.col("cluster").alias("group_id"))
    dom = coldom.select(F.col("id").alias("did")).distinct()
    return spread.join(dom, F.col("col_id") == F.col("did"), "left_semi"), members, edges


def group_pairs(groups: DataFrame) -> DataFrame:
    """(col_a, col_b), col_a < col_b: the pairs of columns of a group."""
    a, b = (groups.select("group_id", F.col("col_id").alias(f"col_{i}")) for i in "ab")
    return a.join(b, "group_id").where("col_a < col_b").select("col_a", "col_b")


def describe_groups(cells: DataFrame, coldom: DataFrame, typical: int = 3, similar: Fraction = SIMILAR) -> DataFrame:
    """(group_id, col_id, size, rank, fit): each group's size and its ``typical`` most typical columns.

    ``fit`` is a column's average similarity to the other columns of its group,
    ties go to the smaller id; a column of coldom without company, also one
    without cells, is a group of size 1 with fit 1.
    """
    groups, members, edges = group_of(cells, coldom, similar)
    groups = materialize(groups)
    ga, gb = (groups.select(F.col("col_id").alias(f"c{i}"), F.col("group_id").alias(f"g{i}")) for i in "ab")
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    ca, cb = (copies.select(F.col("rep").alias(f"r{i}"), F.col("copies").alias(f"w{i}")) for i in "ab")
    inside = edges.join(ga, F.col("a") == F.col("ca")).join(gb, F.col("b") == F.col("cb")).where("ga = gb")
    inside = inside.join(ca, F.col("a") == F.col("ra"), "left").join(cb, F.col("b") == F.col("rb"), "left")
    ends = F.array(F.struct(F.col("a").alias("c"), (F.col("sim") * F.coalesce("wb", F.lit(1))).alias("s")), F.struct(F.col("b").alias("c"), (F.col("sim") * F.coalesce("wa", F.lit(1))).alias("s")))
    sums = inside.select(F.explode(ends).alias("e")).groupBy(F.col("e.c").alias("sc")).agg(F.sum("e.s").alias("s"))
    of = groups.join(members, F.col("col_id") == F.col("id"), "left").withColumn("node", F.coalesce("rep", "col_id"))
    of = of.join(copies.withColumnRenamed("rep", "cr"), F.col("node") == F.col("cr"), "left").join(sums, F.col("node") == F.col("sc"), "left")
    size = groups.groupBy(F.col("group_id").alias("sg")).agg(F.count("*").alias("size"))
    fit = (F.coalesce("s", F.lit(0.0)) + F.coalesce("copies", F.lit(1)) - 1) / (F.col("size") - 1)
    of = of.join(size, F.col("group_id") == F.col("sg")).select("group_id", "col_id", "size", F.when(F.col("size") > 1, fit).otherwise(1.0).alias("fit"))
    of = of.withColumn("rank", F.row_number().over(W.partitionBy("group_id").orderBy(F.round("fit", 12).desc(), F.asc("col_id")))).where(F.col("rank") <= typical)
    alone = coldom.select(F.col("id").alias("col_id")).where("col_id IS NOT NULL").distinct().join(groups.select(F.col("col_id").alias("k")), F.col("col_id") == F.col("k"), "left_anti")
    alone = alone.select(F.col("col_id").alias("group_id"), "col_id", F.lit(1).cast("bigint").alias("size"), F.lit(1.0).alias("fit"), F.lit(1).alias("rank"))
    return of.unionByName(alone).select("group_id", "col_id", "size", "rank", "fit")
