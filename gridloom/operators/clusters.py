"""Clusterings as (cluster, node) tables: repair, comparison and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.matrix import Matrix


def by_smallest(cl: DataFrame) -> DataFrame:
    """Clusters renamed to their smallest node."""
    low = cl.groupBy("cluster").agg(F.min("node").alias("_m"))
    return cl.join(low.withColumnRenamed("cluster", "_c"), F.col("cluster") == F.col("_c")).select(F.col("_m").alias("cluster"), "node")


def enstrict(cl: DataFrame, nodes: DataFrame, overlap: str = "split") -> DataFrame:
    """A partition: nodes in several clusters stay (``keep``), go to the first (``cut``) or form one part for each distinct set of clusters (``split``); missing nodes become clusters of their own, named by negative numbers below all others where a name is taken.

    A node's clusters are few; they are gathered per node, never per cluster.
    """
    cl = cl.join(nodes.select(F.col("id").alias("_i")), F.col("node") == F.col("_i"), "left_semi").distinct()
    if overlap == "cut":
        cl = cl.groupBy("node").agg(F.min("cluster").alias("cluster")).select("cluster", "node")
    elif overlap == "split":
        sig = cl.groupBy("node").agg(F.array_sort(F.collect_set("cluster")).alias("s"))
        part = sig.groupBy("s").agg(F.min("node").alias("first"))
        # parts of one cluster keep its name, shared parts are named by their smallest node, below zero to stay apart
        named = sig.join(part, "s").select(F.when(F.size("s") == 1, F.col("s")[0]).otherwise(-1 - F.col("first")).alias("cluster"), "node")
        cl = named
    lost = nodes.join(cl.select(F.col("node").alias("_n")), F.col("id") == F.col("_n"), "left_anti")
    low = cl.agg(F.coalesce(F.min("cluster"), F.lit(0)).alias("m"))
    single = lost.join(F.broadcast(low)).select((F.least("m", F.lit(0)) - 1 - F.abs("id")).alias("cluster"), F.col("id").alias("node"))
    return cl.select("cluster", "node").unionByName(single)


def defects(cl: DataFrame, nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row: clusters, empty clusters (of ``names`` (id)), missing and overlapping nodes."""
    per = cl.groupBy("node").agg(F.count("*").alias("n"))
    j = nodes.join(per, F.col("id") == F.col("node"), "left")
    a = j.agg(F.sum(F.col("n").isNull().cast("bigint")).alias("missing"), F.sum((F.col("n") > 1).cast("bigint")).alias("overlap"))
    b = cl.agg(F.countDistinct("cluster").alias("clusters"))
    e = (names.join(cl.select(F.col("cluster").alias("_c")), F.col("id") == F.col("_c"), "left_anti") if names is not None else nodes.limit(0)).agg(F.count("*").alias("empty"))
    return b.join(e).join(a)


def sizes(cl: DataFrame) -> DataFrame:
    return cl.groupBy("cluster").agg(F.count("*").alias("size"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n): nodes in both clusters."""
    x = a.select(F.col("cluster").alias("a"), F.col("node").alias("_n"))
    y = b.select(F.col("cluster").alias("b"), F.col("node").alias("_m"))
    return x.join(y, F.col("_n") == F.col("_m")).groupBy("a", "b").agg(F.count("*").alias("n"))


def meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """The coarsest partition finer than both, parts named by their smallest node."""
    x = a.select(F.col("cluster").alias("a"), "node")
    y = b.select(F.col("cluster").alias("b"), F.col("node").alias("_m"))
    j = x.join(y, F.col("node") == F.col("_m"))
    names = j.groupBy("a", "b").agg(F.min("node").alias("cluster"))
    return j.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "node").join(names, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b"))).select("cluster", "node")


def _xlnx(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c) * F.log(c)).otherwise(0.0)


def _pairs(c: str) -> Column:
    return F.col(c) * (F.col(c) - 1) / 2


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of distances between two partitions of the same nodes.

    split_a, split_b (split/join), vi_a, vi_b (variation of information over n,
    natural logarithm), mirkin_a, mirkin_b, rand, adjusted_rand, jaccard. All
    come from the contingency counts, which are computed once.
    """
    t = contingency(a, b)
    sa, sb = t.groupBy("a").agg(F.sum("n").alias("n"), F.max("n").alias("top")), t.groupBy("b").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    part = lambda s, p: s.agg(F.sum("n").alias("total" + p), F.sum(F.col("n") - F.col("top")).alias("split_" + p), F.sum(F.col("n") * F.col("n")).alias("q" + p), F.sum(_xlnx("n")).alias("l" + p), F.sum(_pairs("n")).alias("p" + p))
    m = t.agg(F.sum(F.col("n") * F.col("n")).alias("qm"), F.sum(_xlnx("n")).alias("lm"), F.sum(_pairs("n")).alias("pm"))
    j = part(sa, "a").join(part(sb, "b")).join(m)
    n = F.col("totala")
    every = n * (n - 1) / 2
    expected = F.col("pa") * F.col("pb") / every
    vi = lambda x: F.greatest((F.col(x) - F.col("lm")) / n, F.lit(0.0))
    return j.select(
        F.col("split_a").alias("split_a"), F.col("split_b").alias("split_b"), vi("la").alias("vi_a"), vi("lb").alias("vi_b"),
        (F.col("qa") - F.col("qm")).alias("mirkin_a"), (F.col("qb") - F.col("qm")).alias("mirkin_b"),
        ((every + 2 * F.col("pm") - F.col("pa") - F.col("pb")) / every).alias("rand"),
        ((F.col("pm") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected)).alias("adjusted_rand"),
        (F.col("pm") / (F.col("pa") + F.col("pb") - F.col("pm"))).alias("jaccard"),
    )


def volatility(cls: list[DataFrame]) -> DataFrame:
    """(node, val): over the pairs of clusterings given, Σ 1 / size of the meet part that holds the node."""
    out = None
    for i in range(len(cls)):
        for j in range(i + 1, len(cls)):
            m = meet(cls[i], cls[j])
            one = m.join(sizes(m).withColumnRenamed("cluster", "_c"), F.col("cluster") == F.col("_c")).select("node", (1 / F.col("size")).alias("x"))
            out = one if out is None else out.unionByName(one)
    return out.groupBy("node").agg(F.sum("x").alias("val"))


def mates(a: DataFrame, b: DataFrame, one_to_many: bool = False) -> DataFrame:
    """(a, b, overlap, n, only_a, only_b, size_a, size_b) of overlapping clusters, overlap 2n / (size_a + size_b); ``one_to_many`` keeps pairs in which a cluster of ``a`` meets several."""
    t = contingency(a, b)
    x, y = sizes(a).select(F.col("cluster").alias("_a"), F.col("size").alias("size_a")), sizes(b).select(F.col("cluster").alias("_b"), F.col("size").alias("size_b"))
    if one_to_many:
        t = t.withColumn("_k", F.count("*").over(W.partitionBy("a"))).where("_k > 1").drop("_k")
    t = t.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b"))
    return t.select("a", "b", (2 * F.col("n") / (F.col("size_a") + F.col("size_b"))).alias("overlap"), "n", (F.col("size_a") - F.col("n")).alias("only_a"), (F.col("size_b") - F.col("n")).alias("only_b"), "size_a", "size_b")


def granularity(cl: DataFrame) -> DataFrame:
    """One row: clusters, largest, ctr = Σs²/Σs, mean, smallest, singletons (at most 1 node), quartets (at most 4), log_variance −Σ s ln s, and three that add clusters up from the smallest: dgi, how many it takes to hold as many nodes as the largest; twi, how many larger ones are left when half of all nodes are held; twl, the size of the one that gets there.

    Sizes are added up per distinct size, of which there are few even for many clusters.
    """
    s = sizes(cl)
    a = s.agg(
        F.count("*").alias("clusters"), F.max("size").alias("largest"), (F.sum(F.col("size") * F.col("size")) / F.sum("size")).alias("ctr"), F.avg("size").alias("mean"), F.min("size").alias("smallest"),
        F.sum((F.col("size") <= 1).cast("bigint")).alias("singletons"), F.sum((F.col("size") <= 4).cast("bigint")).alias("quartets"), (-F.sum(_xlnx("size"))).alias("log_variance"), F.sum("size").alias("_total"),
    )
    w = W.orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)
    by = s.groupBy("size").agg(F.count("*").alias("k"))
    run = by.withColumn("upto", F.sum(F.col("size") * F.col("k")).over(w)).withColumn("count", F.sum("k").over(w)).join(F.broadcast(a.select("largest", F.floor((F.col("_total") + 1) / 2).alias("half"), "clusters")))

    def taken(target: str) -> Column:
        return F.col("count") - F.col("k") + F.ceil((F.col(target) - (F.col("upto") - F.col("size") * F.col("k"))) / F.col("size"))

    first = lambda target, v: F.min_by(v, F.when(F.col("upto") >= F.col(target), F.col("size")))
    extra = run.agg(first("largest", taken("largest")).alias("dgi"), first("half", F.col("clusters") - taken("half")).alias("twi"), F.min(F.when(F.col("upto") >= F.col("half"), F.col("size"))).alias("twl"))
    return a.drop("_total").join(extra)


def node_scores(m: Matrix, cl: DataFrame) -> DataFrame:
    """(node, cluster, n_meet, n_out, sum_in, sum_out, ssq, top, self_val, size, cov, covmax): how a node's arcs meet its own cluster.

    cov = 1 − (|C| − (in − out) / (Σ ctr)) / |N ∪ C| with ctr = Σv² / (Σv)², covmax has max / Σ for ctr.
    """
    a = cl.select(F.col("node").alias("_a"), F.col("cluster").alias("_k"))
    b = cl.select(F.col("node").alias("_b"), F.col("cluster").alias("_l"))
    e = m.cells.join(a, F.col("col_id") == F.col("_a")).join(b, (F.col("row_id") == F.col("_b")) & (F.col("_k") == F.col("_l")), "left")
    inside = F.col("_l").isNotNull()
    s = e.groupBy(F.col("col_id").alias("_n"), F.col("_k")).agg(
        F.sum(inside.cast("bigint")).alias("n_meet"), F.sum((~inside).cast("bigint")).alias("n_out"), F.sum(F.when(inside, F.col("val")).otherwise(0.0)).alias("sum_in"), F.sum(F.when(~inside, F.col("val")).otherwise(0.0)).alias("sum_out"),
        F.sum(F.col("val") * F.col("val")).alias("ssq"), F.max("val").alias("top"), F.coalesce(F.max(F.when(F.col("col_id") == F.col("row_id"), F.col("val"))), F.lit(0.0)).alias("self_val"),
    )
    size = sizes(cl).select(F.col("cluster").alias("_c"), "size")
    own = cl.join(size, F.col("cluster") == F.col("_c")).join(s, (F.col("node") == F.col("_n")) & (F.col("cluster") == F.col("_k")), "left")
    z = lambda c, v=0.0: F.coalesce(F.col(c), F.lit(v)).alias(c)
    own = own.select("node", "cluster", z("n_meet", 0), z("n_out", 0), z("sum_in"), z("sum_out"), z("ssq"), z("top"), z("self_val"), "size")
    total = F.col("sum_in") + F.col("sum_out")
    joined = F.col("size") + F.col("n_out")

    def cover(ctr: Column) -> Column:
        return F.when(total > 0, 1 - (F.col("size") - (F.col("sum_in") - F.col("sum_out")) / (total * ctr)) / joined).otherwise(0.0)

    return own.withColumn("cov", cover(F.col("ssq") / (total * total))).withColumn("covmax", cover(F.col("top") / total))


def performance(m: Matrix, cl: DataFrame) -> DataFrame:
    """One row: efficiency (mean cov), max_efficiency, massfrac (mean share of a node's weight inside its cluster), areafrac Σ|C|(|C|−1) / (N(N−1))."""
    s = node_scores(m, cl)
    a = s.agg(F.avg("cov").alias("efficiency"), F.avg("covmax").alias("max_efficiency"), F.avg(F.when(F.col("sum_in") + F.col("sum_out") > 0, F.col("sum_in") / (F.col("sum_in") + F.col("sum_out"))).otherwise(0.0)).alias("massfrac"), F.count("*").alias("_n"))
    b = sizes(cl).agg(F.sum(F.col("size") * (F.col("size") - 1)).alias("_q"))
    return a.join(b).select("efficiency", "max_efficiency", "massfrac", (F.col("_q") / (F.col("_n") * (F.col("_n") - 1))).alias("areafrac"))


def cluster_scores(m: Matrix, cl: DataFrame) -> DataFrame:
    """(cluster, size, cov, covmax, massfrac): averages of ``node_scores`` over each cluster."""
    s = node_scores(m, cl)
    return s.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("cov").alias("cov"), F.avg("covmax").alias("covmax"), F.avg(F.when(F.col("sum_in") + F.col("sum_out") > 0, F.col("sum_in") / (F.col("sum_in") + F.col("sum_out"))).otherwise(0.0)).alias("massfrac"))


def projection(m: Matrix, cl: DataFrame) -> DataFrame:
    """(node, cluster, val): share of a node's weight that goes to each cluster."""
    b = cl.select(F.col("node").alias("_b"), "cluster")
    w = m.cells.join(b, F.col("row_id") == F.col("_b")).groupBy(F.col("col_id").alias("node"), "cluster").agg(F.sum("val").alias("w"))
    total = m.cells.groupBy(F.col("col_id").alias("_n")).agg(F.sum("val").alias("t"))
    return w.join(total, F.col("node") == F.col("_n")).where("t > 0").select("node", "cluster", (F.col("w") / F.col("t")).alias("val"))


def cluster_projection(m: Matrix, cl: DataFrame) -> DataFrame:
    """(a, b, val): average over the nodes of cluster ``a`` of their share to cluster ``b``."""
    p = projection(m, cl)
    own = cl.select(F.col("node").alias("_o"), F.col("cluster").alias("a"))
    n = sizes(cl).select(F.col("cluster").alias("_a"), "size")
    s = p.join(own, F.col("node") == F.col("_o")).groupBy("a", F.col("cluster").alias("b")).agg(F.sum("val").alias("w"))
    return s.join(n, F.col("a") == F.col("_a")).select("a", "b", (F.col("w") / F.col("size")).alias("val"))


def prune_projection(p: DataFrame, fraction: float = 0.9, most: int = 10) -> DataFrame:
    """Each node's heaviest clusters that together reach ``fraction``, at most ``most``."""
    o = W.partitionBy("node").orderBy(F.desc("val"), "cluster")
    c = p.withColumn("_before", F.coalesce(F.sum("val").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_i", F.row_number().over(o))
    return c.where((F.col("_before") < fraction) & (F.col("_i") <= most)).select("node", "cluster", "val")


def residue(m: Matrix, cl: DataFrame) -> DataFrame:
    """Nodes of the graph without a cluster join the one that most of their weight goes to (ties to the smaller name); nodes without weight to any stay out."""
    lost = m.cols.join(cl.select(F.col("node").alias("_n")), F.col("id") == F.col("_n"), "left_anti").select(F.col("id").alias("_i"))
    p = projection(m, cl).join(lost, F.col("node") == F.col("_i"), "left_semi")
    best = p.groupBy("node").agg(F.max(F.struct("val", (-F.col("cluster")).alias("k"))).alias("z")).select((-F.col("z.k")).alias("cluster"), "node")
    return cl.select("cluster", "node").unionByName(best)


def assimilate(m: Matrix, cl: DataFrame, largest: int) -> DataFrame:
    """Nodes of clusters of at most ``largest`` nodes join the bigger cluster that their cluster gives most weight to; a cluster without weight to bigger ones stays."""
    s = sizes(cl)
    small, big = s.where(F.col("size") <= largest), s.where(F.col("size") > largest)
    p = cluster_projection(m, cl).join(small.select(F.col("cluster").alias("_s")), F.col("a") == F.col("_s"), "left_semi").join(big.select(F.col("cluster").alias("_b")), F.col("b") == F.col("_b"), "left_semi")
    to = p.groupBy("a").agg(F.max(F.struct("val", (-F.col("b")).alias("k"))).alias("z")).select("a", (-F.col("z.k")).alias("to"))
    return cl.join(to, F.col("cluster") == F.col("a"), "left").select(F.coalesce("to", "cluster").alias("cluster"), "node")


def adjust(m: Matrix, cl: DataFrame, largest: int, rounds: int = 100) -> DataFrame:
    """Move nodes of clusters of at most ``largest`` nodes to the cluster with most of their weight, all at once, for as long as the share of weight inside clusters rises."""
    from gridloom.plans.materialize import materialize

    cl = materialize(cl.select("cluster", "node"))
    best = performance(m, cl).first().massfrac or 0.0
    for _ in range(rounds):
        small = sizes(cl).where(F.col("size") <= largest).select(F.col("cluster").alias("_s"))
        own = cl.join(small, F.col("cluster") == F.col("_s"), "left_semi").select(F.col("node").alias("_o"))
        p = projection(m, cl).join(own, F.col("node") == F.col("_o"), "left_semi")
        to = p.groupBy("node").agg(F.max(F.struct("val", (-F.col("cluster")).alias("k"))).alias("z")).select(F.col("node").alias("_t"), (-F.col("z.k")).alias("to"))
        nxt = materialize(cl.join(to, F.col("node") == F.col("_t"), "left").select(F.coalesce("to", "cluster").alias("cluster"), "node"))
        got = performance(m, nxt).first().massfrac or 0.0
        if got <= best:
            break
        cl, best = nxt, got
    return cl


def project(cl: DataFrame, nodes: DataFrame) -> DataFrame:
    """A clustering restricted to some nodes; overlap is split."""
    return enstrict(cl, nodes, "split")


def component_refinement(m: Matrix, cl: DataFrame) -> DataFrame:
    """Clusters split into their connected parts, named by their smallest node."""
    from gridloom.operators.graphs import components
    from gridloom.operators.reshape import block_union

    nodes = cl.select(F.col("node").alias("id")).distinct()
    return components(Matrix(block_union(m, cl).cells, nodes, nodes)).select(F.col("component").alias("cluster"), "node")


def nested_scores(m: Matrix, child: DataFrame, parent: DataFrame) -> DataFrame:
    """(cluster, parent, size, cov, covmax, massfrac, within_cov, within_covmax, within_massfrac): each child cluster scored in the whole graph and in the graph of its parent cluster alone; a child that is all of its parent is trivial and scores 1 within."""
    from gridloom.operators.reshape import block_union

    of = contingency(child, parent).select(F.col("a").alias("cluster"), F.col("b").alias("parent"), "n")
    top = sizes(parent).select(F.col("cluster").alias("_p"), F.col("size").alias("_ps"))
    whole = cluster_scores(m, child).withColumnRenamed("cluster", "_w")
    inner = cluster_scores(block_union(m, parent), child).select(F.col("cluster").alias("_i"), F.col("cov").alias("within_cov"), F.col("covmax").alias("within_covmax"), F.col("massfrac").alias("within_massfrac"))
    j = of.join(top, F.col("parent") == F.col("_p")).join(whole, F.col("cluster") == F.col("_w")).join(inner, F.col("cluster") == F.col("_i"))
    trivial = F.col("size") == F.col("_ps")
    one = lambda c: F.when(trivial, 1.0).otherwise(F.col(c)).alias(c)
    return j.select("cluster", "parent", "size", "cov", "covmax", "massfrac", one("within_cov"), one("within_covmax"), one("within_massfrac"))


def graph_closure(m: Matrix, cl: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(cluster, part, node, size): connected parts of every cluster, within the size bounds."""
    p = component_refinement(m, cl).select(F.col("cluster").alias("part"), F.col("node").alias("_n"))
    j = cl.join(p, F.col("node") == F.col("_n")).withColumn("size", F.count("*").over(W.partitionBy("part")))
    j = j.where(F.col("size") >= least)
    if most is not None:
        j = j.where(F.col("size") <= most)
    return j.select("cluster", "part", "node", "size")
