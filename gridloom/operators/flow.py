"""Flow clustering: expansion and inflation of a column-stochastic matrix until it stands still.

One iteration is one sparse product, one window pass that prunes, rescales and
inflates, and one small aggregate for convergence. Iterands are written to the
shared folder, which cuts their lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.matrix import Matrix
from gridloom.operators import clusters
from gridloom.operators.aggregates import inflate, stochastic
from gridloom.operators.graphs import components
from gridloom.operators.reshape import scale_loops, set_loops
from gridloom.operators.setops import compose
from gridloom.plans.materialize import materialize, release, sweep

# fixed values: pruning number, selection number, recovery number and recovery percentage of each scheme
SCHEMES = {1: (3000, 400, 500, 90), 2: (4000, 500, 600, 90), 3: (5000, 600, 700, 90), 4: (6000, 700, 800, 90), 5: (7000, 800, 900, 90), 6: (10000, 1100, 1400, 90), 7: (10000, 1200, 1600, 90)}


@dataclass(frozen=True)
class Flow:
    inflation: float = 2.0
    scheme: int = 6
    initial_inflation: float = 2.0
    initial_length: int = 0
    chaos: float = 1e-4
    most: int = 10_000
    precision: float | None = None
    select: int | None = None
    recover: int | None = None
    percent: float | None = None

    def numbers(self) -> tuple[float, int, int, float]:
        p, s, r, pct = SCHEMES[self.scheme]
        return (
            0.99999 / p if self.precision is None else self.precision,
            s if self.select is None else self.select,
            r if self.recover is None else self.recover,
            (pct if self.percent is None else self.percent) / 100,
        )


def prepare(m: Matrix, loops: float = 1.0, pre_inflation: float | None = None) -> Matrix:
    """Loops of the largest weight in the column (times ``loops``), then columns of sum 1."""
    m = stochastic(scale_loops(set_loops(m, "max"), loops))
    return inflate(m, pre_inflation) if pre_inflation else m


def prune(m: Matrix, precision: float, select: int = 0, recover: int = 0, percent: float = 0.9) -> DataFrame:
    """Pruned columns of sum 1 with their convergence number, as (col_id, row_id, val, chaos).

    Cells below ``precision`` go. A column left with fewer than ``recover``
    cells and less mass than ``percent`` gets back its largest ones up to that
    number; one left with more than ``select`` keeps that many of its largest.
    Cells tied with the last one kept stay. ``chaos`` is (max - Σv²) of the
    column before pruning times the cells it keeps. A column left with nothing
    keeps its loop.
    """
    by = W.partitionBy("col_id")
    o = by.orderBy(F.desc("val"))
    c = m.cells.withColumn("_i", F.row_number().over(o))
    big = F.col("val") >= precision
    c = c.select(
        "*", F.max("val").over(by).alias("_top"), F.sum(F.col("val") * F.col("val")).over(by).alias("_q"), F.sum(big.cast("int")).over(by).alias("_n"), F.sum(F.when(big, F.col("val")).otherwise(0.0)).over(by).alias("_mass"),
        F.max(F.when(F.col("_i") == max(recover, 1), F.col("val"))).over(by).alias("_rbar"), F.max(F.when(F.col("_i") == max(select, 1), F.col("val"))).over(by).alias("_sbar"),
    )
    least = F.lit(precision)
    starved = (F.col("_n") < recover) & (F.col("_mass") < percent)
    crowded = (F.col("_n") > select) if select else F.lit(False)
    # what selection leaves may itself be too little
    left = F.sum(F.when(F.col("val") >= F.greatest(F.col("_sbar"), least), F.col("val")).otherwise(0.0)).over(by)
    c = c.withColumn("_left", left)
    again = (F.col("_left") < percent) & F.lit(recover > select)
    bar = F.when(starved, F.coalesce("_rbar", F.lit(0.0))).when(crowded, F.when(again, F.greatest(F.coalesce("_rbar", F.lit(0.0)), least)).otherwise(F.greatest(F.col("_sbar"), least))).otherwise(least)
    kept = c.withColumn("_bar", bar).where("val >= _bar")
    kept = kept.withColumn("_m", F.sum("val").over(by)).withColumn("_k", F.count("*").over(by))
    out = kept.select("col_id", "row_id", (F.col("val") / F.col("_m")).alias("val"), ((F.col("_top") - F.col("_q")) * F.col("_k")).alias("chaos"))
    if recover == 0:
        some = out.select(F.col("col_id").alias("_c")).distinct()
        bare = m.cols.join(some, F.col("id") == F.col("_c"), "left_anti")
        out = out.unionByName(bare.select(F.col("id").alias("col_id"), F.col("id").alias("row_id"), F.lit(1.0).alias("val"), F.lit(0.0).alias("chaos")))
    return out


def expand(m: Matrix, right: Matrix | None = None) -> Matrix:
    return compose(m, m if right is None else right)


def iterate(m: Matrix, flow: Flow, inflation: float) -> tuple[Matrix, float]:
    """One expansion and inflation; the new iterand and its chaos."""
    pruned = prune(expand(m), *flow.numbers())
    p = pruned.withColumn("_p", F.pow("val", F.lit(float(inflation))))
    both = p.select("col_id", "row_id", (F.col("_p") / F.sum("_p").over(W.partitionBy("col_id"))).alias("val"), "chaos").where("val <> 0")
    after = materialize(both)
    chaos = after.agg(F.max("chaos").alias("c")).first().c or 0.0
    cells = after.select("col_id", "row_id", "val")
    cells._gridloom_path = after._gridloom_path
    return Matrix(cells, m.cols, m.rows), chaos


def limit(start: Matrix, flow: Flow = Flow()) -> Matrix:
    """The iterand at which chaos falls below the bound; one that does not within ``flow.most`` rounds is an error."""
    m = start.put(materialize(start.cells))
    for n in range(flow.most):
        nxt, chaos = iterate(m, flow, flow.initial_inflation if n < flow.initial_length else flow.inflation)
        release(start.cells.sparkSession, m.cells)
        m = nxt
        if n >= flow.initial_length and chaos < flow.chaos:
            break
        if n % 4 == 3:
            sweep(start.cells.sparkSession)
    else:
        raise RuntimeError(f"the flow did not settle in {flow.most} rounds")
    return m


def dag(m: Matrix) -> Matrix:
    """Arcs at least near the loop's weight: .999 loop + .001 max where the loop is not the largest, else loop / 1.01."""
    by = W.partitionBy("col_id")
    c = m.cells.withColumn("_s", F.coalesce(F.max(F.when(F.col("col_id") == F.col("row_id"), F.col("val"))).over(by), F.lit(0.0))).withColumn("_m", F.max("val").over(by))
    bar = F.when(F.col("_s") < F.col("_m"), 0.999 * F.col("_s") + 0.001 * F.col("_m")).otherwise(F.col("_s") / 1.01)
    d = stochastic(m.put(c.withColumn("_b", bar).where("val >= _b")))
    n = F.count("*").over(by)
    return m.put(d.cells.withColumn("_n", n).where("val >= 1 / (_n + 1)"))


def interpret(d: Matrix) -> DataFrame:
    """(cluster, node): attractors (nodes with a loop) form systems, the components among them; every node belongs to each system it reaches. Clusters are named by their smallest attractor; clusters may overlap."""
    arcs = materialize(d.cells)
    attractors = arcs.where("col_id = row_id").select(F.col("col_id").alias("id"))
    systems = components(Matrix.graph(arcs.select("col_id", "row_id", "val"), attractors))
    known = materialize(systems.select(F.col("component").alias("cluster"), "node"))
    steps = materialize(arcs.where("col_id <> row_id").select(F.col("col_id").alias("a"), F.col("row_id").alias("b")).join(attractors.select(F.col("id").alias("_i")), F.col("a") == F.col("_i"), "left_anti"))
    front = known
    while True:
        reach = steps.join(front, F.col("b") == F.col("node")).select("cluster", F.col("a").alias("node")).distinct()
        old = known.select(F.col("cluster").alias("_k"), F.col("node").alias("_n"))
        front = materialize(reach.join(old, (F.col("cluster") == F.col("_k")) & (F.col("node") == F.col("_n")), "left_anti"))
        if front.isEmpty():
            return known
        known = materialize(known.unionByName(front))


def cluster(graph: Matrix, flow: Flow = Flow(), overlap: str = "split") -> DataFrame:
    """(cluster, node): a partition of the graph's nodes, each cluster named by its smallest node.

    Nodes without arcs are clusters of their own. Overlap is resolved as in
    ``clusters.enstrict``.
    """
    nodes = materialize(graph.cols)
    start = prepare(Matrix(materialize(graph.cells), nodes, nodes))
    found = interpret(dag(limit(start, flow)))
    return clusters.by_smallest(clusters.enstrict(found, nodes, overlap))


def attractivity(m: Matrix) -> DataFrame:
    """(node, val): loop over the column's largest weight."""
    s = m.cells.groupBy("col_id").agg(F.max(F.when(F.col("col_id") == F.col("row_id"), F.col("val"))).alias("s"), F.max("val").alias("m"))
    return s.select(F.col("col_id").alias("node"), (F.coalesce("s", F.lit(0.0)) / F.col("m")).alias("val"))


def homogeneity(src: Matrix, dst: Matrix, inflation: float = 2.0) -> DataFrame:
    """(col_id, val): Σs² (Σd^r)² / Σd^(2r) of source and expanded column."""
    s = src.cells.groupBy(F.col("col_id").alias("c")).agg(F.sum(F.col("val") * F.col("val")).alias("s"))
    p = F.pow("val", F.lit(float(inflation)))
    d = dst.cells.groupBy("col_id").agg(F.sum(p).alias("x"), F.sum(p * p).alias("y"))
    return d.join(s, F.col("col_id") == F.col("c")).select("col_id", (F.col("s") * F.col("x") * F.col("x") / F.col("y")).alias("val"))


def shadow(m: Matrix, factors: DataFrame, offset: int) -> Matrix:
    """The graph on twice the nodes: each node (id, val) gets a shadow (id + offset) tied to it by ``val`` and looped with it."""
    f = factors.where("val > 0")
    tie = f.select(F.col("id").alias("col_id"), (F.col("id") + offset).alias("row_id"), "val")
    more = tie.unionByName(tie.select(F.col("row_id").alias("col_id"), F.col("col_id").alias("row_id"), "val")).unionByName(f.select((F.col("id") + offset).alias("col_id"), (F.col("id") + offset).alias("row_id"), "val"))
    nodes = m.cols.unionByName(m.cols.select((F.col("id") + offset).alias("id")))
    return Matrix(m.cells.unionByName(more), nodes, nodes)


def diagonal_order(m: Matrix, slack: float = 1e-12) -> tuple[Matrix, DataFrame]:
    """(arcs, (node, val)): of columns with a loop, the cells not below the larger of the loop and Σv²; and every node's attraction, loop over Σv²."""
    by = W.partitionBy("col_id")
    own = F.max(F.when(F.col("col_id") == F.col("row_id"), F.col("val"))).over(by)
    c = m.cells.withColumn("_s", own).withColumn("_q", F.sum(F.col("val") * F.col("val")).over(by))
    kept = m.put(c.where(F.col("_s").isNotNull() & (F.col("val") >= F.greatest("_s", "_q") - slack)))
    s = m.cells.groupBy("col_id").agg(F.max(F.when(F.col("col_id") == F.col("row_id"), F.col("val"))).alias("s"), F.sum(F.col("val") * F.col("val")).alias("q"))
    return kept, s.select(F.col("col_id").alias("node"), F.when(F.col("q") > 0, F.coalesce("s", F.lit(0.0)) / F.col("q")).otherwise(0.0).alias("val"))


def shadow_factors(m: Matrix, strength: float = 1.0, sizes: str | None = "high", weights: str | None = "high", multiply: bool = False, own_arcs: bool = False) -> DataFrame:
    """(id, val): how much a node stands out among its neighbours, for ``shadow``.

    A node's number of arcs and mean weight are compared with those of its
    neighbours, averaged with the node's weight shares; ``high`` counts nodes
    above, ``low`` nodes below. A neighbour's mean leaves out its arc back to the
    node unless ``own_arcs`` or it has no other. The larger of both ratios (or
    their product) to the power ``strength``, less 1; 0 where nothing stands out.
    """
    s = m.cells.groupBy("col_id").agg(F.count("*").alias("n"), F.sum("val").alias("t"))
    mine = s.select(F.col("col_id").alias("_m"), F.col("n").alias("n0"), F.col("t").alias("t0"))
    near = s.select(F.col("col_id").alias("_k"), F.col("n").alias("n1"), F.col("t").alias("t1"))
    back = m.cells.select(F.col("row_id").alias("_bm"), F.col("col_id").alias("_bk"), F.col("val").alias("back"))
    j = m.cells.join(mine, F.col("col_id") == F.col("_m")).join(near, F.col("row_id") == F.col("_k"), "left").join(back, (F.col("col_id") == F.col("_bm")) & (F.col("row_id") == F.col("_bk")), "left")
    share = F.col("val") / F.col("t0")
    whole = F.col("t1") / F.col("n1")
    others = whole if own_arcs else F.when(F.col("back").isNull() | (F.col("n1") < 2), whole).otherwise((F.col("t1") - F.col("back")) / (F.col("n1") - 1))
    per = j.groupBy("col_id").agg(F.first("n0").alias("n0"), F.first("t0").alias("t0"), F.sum(share * F.coalesce("n1", F.lit(0))).alias("size"), F.sum(share * F.coalesce(others, F.lit(0.0))).alias("gauge"))
    mean = F.col("t0") / F.col("n0")

    def ratio(own, local, way: str | None):
        if way is None:
            return F.lit(1.0)
        return F.when(own > local, own / local).otherwise(1.0) if way == "high" else F.when(own < local, local / own).otherwise(1.0)

    a, b = ratio(F.col("n0"), F.col("size"), sizes), ratio(mean, F.col("gauge"), weights)
    f = F.pow(F.greatest(a * b if multiply else F.greatest(a, b), F.lit(1.0)), F.lit(float(strength))) - 1
    ok = (F.col("gauge") > 0) & (F.col("size") > 0) & (mean > 0)
    v = per.select(F.col("col_id").alias("_c"), F.when(ok, f).otherwise(0.0).alias("v"))
    return m.cols.join(v, F.col("id") == F.col("_c"), "left").select("id", F.coalesce("v", F.lit(0.0)).alias("val"))
