"""Hierarchies of clusterings: (level, cluster, node), level 0 the finest.

In a stack every level clusters the leaves, in a cone each level clusters the
clusters of the level below. The number of levels is small; work is per level,
never per cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.matrix import Matrix
from gridloom.operators import clusters
from gridloom.operators.aggregates import stochastic
from gridloom.operators.flow import Flow, cluster
from gridloom.operators.reshape import block_union, drop_loops
from gridloom.operators.setops import add_transpose, compose
from gridloom.plans.materialize import materialize


def level(h: DataFrame, n: int) -> DataFrame:
    return h.where(F.col("level") == n).select("cluster", "node")


def depth(h: DataFrame) -> int:
    m = h.agg(F.max("level").alias("m")).first().m
    return 0 if m is None else m + 1


def stack(levels: list[DataFrame]) -> DataFrame:
    out = None
    for i, c in enumerate(levels):
        one = c.select(F.lit(i).alias("level"), "cluster", "node")
        out = one if out is None else out.unionByName(one)
    return out


def conify(h: DataFrame) -> DataFrame:
    """Stack to cone: the nodes of a level become the clusters of the level below."""
    low = h.select((F.col("level") + 1).alias("_l"), F.col("cluster").alias("_c"), F.col("node").alias("_n"))
    up = h.where("level > 0").join(low, (F.col("level") == F.col("_l")) & (F.col("node") == F.col("_n")))
    return h.where("level = 0").unionByName(up.select("level", "cluster", F.col("_c").alias("node")).distinct())


def unconify(h: DataFrame) -> DataFrame:
    """Cone to stack: every level spread to the leaves."""
    out = [level(h, 0)]
    for n in range(1, depth(h)):
        below = out[-1].select(F.col("cluster").alias("_c"), F.col("node").alias("leaf"))
        out.append(level(h, n).join(below, F.col("node") == F.col("_c")).select("cluster", F.col("leaf").alias("node")))
    return stack(out)


def reverse(h: DataFrame) -> DataFrame:
    return h.withColumn("level", F.lit(depth(h) - 1) - F.col("level"))


def transpose_all(h: DataFrame) -> DataFrame:
    return h.select("level", F.col("node").alias("cluster"), F.col("cluster").alias("node"))


def coarseness(h: DataFrame) -> DataFrame:
    """(level, ssq): Σ size² of each level."""
    return h.groupBy("level", "cluster").agg(F.count("*").alias("n")).groupBy("level").agg(F.sum(F.col("n") * F.col("n")).alias("ssq"))


def sort_levels(h: DataFrame, coarse_first: bool = True) -> DataFrame:
    o = F.desc("ssq") if coarse_first else F.asc("ssq")
    new = coarseness(h).select(F.col("level").alias("_l"), (F.row_number().over(W.orderBy(o, "level")) - 1).alias("_n"))
    return h.join(F.broadcast(new), F.col("level") == F.col("_l")).select(F.col("_n").alias("level"), "cluster", "node")


def is_nested(h: DataFrame) -> bool:
    """Whether in a stack each cluster lies within one cluster of the next level."""
    up = h.select((F.col("level") - 1).alias("_l"), F.col("cluster").alias("_c"), F.col("node").alias("_n"))
    j = h.join(up, (F.col("level") == F.col("_l")) & (F.col("node") == F.col("_n")))
    return j.groupBy("level", "cluster").agg(F.countDistinct("_c").alias("k")).where("k > 1").isEmpty()


def has_one_domain(h: DataFrame) -> bool:
    """Whether all levels cluster the same nodes."""
    return h.select("level", "node").distinct().groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") != depth(h)).isEmpty()


def integrate(levels: list[DataFrame]) -> DataFrame:
    """Nested levels out of any partitions: coarsest first, each met with the one before, given back finest first."""
    h = sort_levels(stack(levels))
    out = []
    for n in range(len(levels)):
        own = level(h, n)
        out.append(own if not out else clusters.meet(out[-1], own))
    return stack(out[::-1])


def coarse_graph(m: Matrix, cl: DataFrame, transpose: bool = False) -> Matrix:
    """The graph of clusters: clᵀ · (arcs between clusters · columns of cl made stochastic)."""
    nodes, names = m.cols, cl.select(F.col("cluster").alias("id")).distinct()
    off = block_union(m, cl, inside=False)
    member = Matrix(cl.select(F.col("cluster").alias("col_id"), F.col("node").alias("row_id"), F.lit(1.0).alias("val")), names, nodes)
    g = compose(member.t, compose(off, stochastic(member)))
    return drop_loops(add_transpose(g, 0.5)) if transpose else g


def contract(m: Matrix, flow: Flow = Flow(), most: int = 20, root: bool = False) -> DataFrame:
    """Cluster, contract to the graph of clusters, cluster again, until a level repeats the one before or no arcs are left; a cone. ``root`` adds a last level of one cluster; a graph that still contracts after ``most`` levels is an error."""
    g = Matrix(materialize(m.cells), materialize(m.cols), m.cols)
    out = []
    for _ in range(most):
        cl = materialize(cluster(g, flow))
        n, k = cl.count(), cl.select("cluster").distinct().count()
        if out and n == k:
            break
        out.append(cl)
        if k == 1:
            break
        nxt = coarse_graph(g, cl)
        g = Matrix(materialize(nxt.cells), materialize(nxt.cols), nxt.cols)
        if g.cells.isEmpty():
            break
    else:
        raise RuntimeError(f"the clusters did not settle within {most} levels")
    h = stack(out)
    if root:
        top = level(h, len(out) - 1).agg(F.min("cluster").alias("c"))
        last = level(h, len(out) - 1).select(F.col("cluster").alias("node")).distinct().join(F.broadcast(top)).select(F.lit(len(out)).alias("level"), F.col("c").alias("cluster"), "node")
        h = h.unionByName(last)
    return h


def stable(h: DataFrame, least: float = 0.5) -> DataFrame:
    """(level, cluster, upper, identity): clusters of a stack whose best match on the next coarser level shares more than ``least`` of the union."""
    size = h.groupBy(F.col("level").alias("sl"), F.col("cluster").alias("sc")).agg(F.count("*").alias("n"))
    up = h.select((F.col("level") - 1).alias("_l"), F.col("cluster").alias("upper"), F.col("node").alias("_n"))
    t = h.join(up, (F.col("level") == F.col("_l")) & (F.col("node") == F.col("_n"))).groupBy("level", "cluster", "upper").agg(F.count("*").alias("m"))
    t = t.join(size.withColumnRenamed("n", "a"), (F.col("level") == F.col("sl")) & (F.col("cluster") == F.col("sc"))).drop("sl", "sc")
    t = t.join(size.withColumnRenamed("n", "b"), (F.col("level") + 1 == F.col("sl")) & (F.col("upper") == F.col("sc")))
    t = t.select("level", "cluster", "upper", (F.col("m") / (F.col("a") + F.col("b") - F.col("m"))).alias("identity"))
    best = F.row_number().over(W.partitionBy("level", "upper").orderBy(F.desc("identity"), "cluster"))
    return t.withColumn("_r", best).where((F.col("_r") == 1) & (F.col("identity") > least)).drop("_r")


def nested_order(h: DataFrame) -> DataFrame:
    """(node, path): the leaves of a stack with their clusters from coarsest to finest, larger clusters first; sorting by ``path`` puts every cluster of every level together."""
    size = h.groupBy(F.col("level").alias("sl"), F.col("cluster").alias("sc")).agg(F.count("*").alias("n"))
    j = h.join(size, (F.col("level") == F.col("sl")) & (F.col("cluster") == F.col("sc")))
    key = F.struct((-F.col("level")).alias("l"), (-F.col("n")).alias("s"), F.col("cluster").alias("c"))
    return j.groupBy("node").agg(F.array_sort(F.collect_list(key)).alias("path"))


def newick(h: DataFrame, names: DataFrame | None = None, lengths: bool = True, single_parentheses: bool = True) -> DataFrame:
    """(tree): a nested cone as one Newick line a cluster of the top level.

    Folded level by level: each cluster joins its parts' text in the order of
    their ids. A cluster of one part adds one to the branch below it, any other
    starts at 1.5. The text of a top cluster is as large as what it holds, as
    the format asks.
    """
    n = depth(h)
    # branch lengths come from the root down
    length = {n - 1: level(h, n - 1).groupBy("cluster").agg(F.count("*").alias("k")).withColumn("len", F.lit(1.0))}
    for i in range(n - 1, 0, -1):
        up = level(h, i).join(length[i].select(F.col("cluster").alias("_c"), F.col("k"), F.col("len")), F.col("cluster") == F.col("_c"))
        down = up.select(F.col("node").alias("_n"), F.when(F.col("k") == 1, F.col("len") + 1).otherwise(1.5).alias("len"))
        size = level(h, i - 1).groupBy("cluster").agg(F.count("*").alias("k"))
        length[i - 1] = size.join(down, F.col("cluster") == F.col("_n")).select("cluster", "k", "len")
    leaf = level(h, 0)
    if names is not None:
        leaf = leaf.join(names.select(F.col("id").alias("_i"), "label"), F.col("node") == F.col("_i"), "left").select("cluster", "node", F.coalesce("label", F.lit("?")).alias("text"))
    else:
        leaf = leaf.withColumn("text", F.col("node").cast("string"))
    parts = leaf
    for i in range(n):
        joined: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), ",")
        body = parts.groupBy(F.col("cluster").alias("_b")).agg(joined.alias("t"), F.count("*").alias("k2"))
        body = body.join(length[i].select("cluster", "len"), F.col("_b") == F.col("cluster"))
        text = F.when((F.col("k2") > 1) | F.lit(single_parentheses), F.concat(F.lit("("), F.col("t"), F.lit(")"))).otherwise(F.col("t"))
        if lengths:
            text = F.concat(text, F.lit(":"), F.floor("len").cast("string"))
        done = body.select("cluster", text.alias("text"))
        if i + 1 < n:
            parts = level(h, i + 1).join(done.select(F.col("cluster").alias("_d"), "text"), F.col("node") == F.col("_d")).select("cluster", "node", "text")
    return done.select("cluster", F.concat("text", F.lit(";")).alias("tree"))


def level_scores(m: Matrix, h: DataFrame) -> DataFrame:
    """``clusters.performance`` of every level of a stack."""
    out = None
    for n in range(depth(h)):
        one = clusters.performance(m, level(h, n)).withColumn("level", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out
