"""Graph measures: components, searches, shortest paths, centrality, clustering coefficients, cycles and sweeps.

Searches keep (source, node, distance) tables and widen them by one join a
round; every round is written to the shared folder, so neither lineage nor the
plan grows with the number of rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.matrix import Matrix, domain
from gridloom.operators.setops import domain_meet
from gridloom.plans.materialize import Levels, counted, materialize, release
from gridloom.plans.ordering import running

MAX_ROUNDS = 1000
#: Edges whose components are found inside one task, which holds them as 16 bytes each.
LOCAL_EDGES = 1 << 22


def _settle(batches: Iterator) -> Iterator:
    """(component, _n) of the nodes of all edges (a, b) given: roots hook onto the smallest root seen across their edges, then pointers are halved until flat; edges inside a tree go."""
    import numpy as np
    import pyarrow as pa

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    ids, code = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    a, b = np.split(code, 2)
    root = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    for at in range(0, len(ids), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[part]]), pa.array(ids[part])], ["component", "_n"])


def arcs_of(m: Matrix) -> DataFrame:
    """(a, b): arcs without loops."""
    return m.cells.where("col_id <> row_id").select(F.col("col_id").alias("a"), F.col("row_id").alias("b"))


def edges_of(m: Matrix) -> DataFrame:
    """(a, b) both ways round, without loops and repeats."""
    one = arcs_of(m)
    return one.union(one.select("b", "a")).distinct()


def components(m: Matrix, nodes: DataFrame | None = None) -> DataFrame:
    """(component, node): weakly connected components, named by their smallest node; optionally of the graph on ``nodes``.

    Up to LOCAL_EDGES edges are settled inside one task. Of more, labels fall to
    the smallest neighbour's and then jump to their label's label, a round a
    few jobs.
    """
    dom = m.cols if nodes is None else domain_meet(m.cols, nodes)
    e = edges_of(m)
    if nodes is not None:
        e = e.join(dom.select(F.col("id").alias("_x")), F.col("a") == F.col("_x"), "left_semi").join(dom.select(F.col("id").alias("_y")), F.col("b") == F.col("_y"), "left_semi")
    e, seen = counted(e, n=F.count(F.lit(1)))
    if seen["n"] <= 2 * LOCAL_EDGES:
        found = e.where("a < b").coalesce(1).mapInArrow(_settle, "component bigint, _n bigint")
        found = materialize(dom.join(found, F.col("id") == F.col("_n"), "left").select(F.coalesce("component", "id").alias("component"), F.col("id").alias("node")))
        release(m.cells.sparkSession, e)
        return found
    label = materialize(dom.select(F.col("id").alias("node"), F.col("id").alias("lab")))
    for _ in range(MAX_ROUNDS):
        near = e.join(label.select(F.col("node").alias("n"), F.col("lab").alias("l")), F.col("b") == F.col("n")).groupBy("a").agg(F.min("l").alias("l"))
        low = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("lab", F.coalesce("l", "lab")).alias("lab"), F.col("lab").alias("was"))
        jump = low.select(F.col("node").alias("n"), F.col("lab").alias("l"))
        after, seen = counted(low.join(jump, F.col("lab") == F.col("n"), "left").select("node", F.least("lab", F.coalesce("l", "lab")).alias("lab"), "was"), moved=F.count_if(F.col("lab") != F.col("was")))
        release(m.cells.sparkSession, label)
        label = after
        if not seen["moved"]:
            return label.select(F.col("lab").alias("component"), "node")
    raise RuntimeError("components did not settle")


def component_sizes(m: Matrix) -> DataFrame:
    return components(m).groupBy("component").agg(F.count("*").alias("size"))


def distances(m: Matrix, sources: DataFrame, most: int | None = None, directed: bool = False) -> DataFrame:
    """(src, node, dist): breadth-first distances from every source (id), the source itself at 0. Without ``most``, nodes still unreached after MAX_ROUNDS steps are an error."""
    e = materialize(arcs_of(m).distinct() if directed else edges_of(m))
    levels = Levels(m.cells.sparkSession)
    levels.add(sources.select(F.col("id").alias("src"), F.col("id").alias("node"), F.lit(0).alias("dist")))
    for d in range(1, (most if most is not None else MAX_ROUNDS) + 1):
        step = levels.read(1).join(e, F.col("node") == F.col("a")).select("src", F.col("b").alias("node")).distinct()
        # an edge leads no farther back than one level, an arc to any
        known = levels.read(0 if directed else 2).select(F.col("src").alias("_s"), F.col("node").alias("_n"))
        if not levels.add(step.join(known, (F.col("src") == F.col("_s")) & (F.col("node") == F.col("_n")), "left_anti").withColumn("dist", F.lit(d))):
            break
    else:
        if most is None:
            raise RuntimeError(f"nodes still come within reach after {MAX_ROUNDS} steps")
    return levels.read()


def disc(m: Matrix, ids: DataFrame, steps: int) -> DataFrame:
    """(id): nodes within ``steps`` of the ids; -1 is without limit."""
    return distances(m, ids, None if steps < 0 else steps).select(F.col("node").alias("id")).distinct()


def eccentricity(m: Matrix) -> DataFrame:
    """(node, ecc): the farthest reachable node's distance."""
    return distances(m, m.cols).groupBy(F.col("src").alias("node")).agg(F.max("dist").alias("ecc"))


def diameter(m: Matrix) -> DataFrame:
    return eccentricity(m).agg(F.max("ecc").alias("diameter"), F.avg("ecc").alias("mean_ecc"))


def betweenness(m: Matrix, with_ends: bool = False) -> DataFrame:
    """(node, score): over ordered pairs, path shares through inner nodes; with ``with_ends`` also at the ends.

    Path counts go down the distance levels and dependencies come back up, one
    join a level for all sources together.
    """
    e = materialize(edges_of(m))
    dist = materialize(distances(m, m.cols))
    depth = dist.agg(F.max("dist").alias("d")).first().d or 0
    at = lambda d: dist.where(F.col("dist") == d)
    sigma = {0: materialize(at(0).select("src", "node", F.lit(1.0).alias("paths")))}
    for d in range(1, depth + 1):
        up = sigma[d - 1].join(e, F.col("node") == F.col("a")).groupBy("src", F.col("b").alias("to")).agg(F.sum("paths").alias("paths"))
        here = at(d).select(F.col("src").alias("_s"), F.col("node").alias("_n"))
        sigma[d] = materialize(here.join(up, (F.col("_s") == F.col("src")) & (F.col("_n") == F.col("to"))).select("src", F.col("to").alias("node"), "paths"))
    parts, below = [], None
    for d in range(depth, 0, -1):
        own = sigma[d]
        if below is not None:
            kids = below.select(F.col("src").alias("ks"), F.col("node").alias("kn"), (F.col("dep") / F.col("paths")).alias("q"))
            got = e.join(kids, F.col("b") == F.col("kn")).groupBy("ks", "a").agg(F.sum("q").alias("q"))
            own = own.join(got, (F.col("src") == F.col("ks")) & (F.col("node") == F.col("a")), "left").select("src", "node", "paths", (F.lit(1.0) + F.col("paths") * F.coalesce("q", F.lit(0.0))).alias("dep"))
        else:
            own = own.withColumn("dep", F.lit(1.0))
        below = materialize(own)
        parts.append(below.select("node", (F.col("dep") if with_ends else F.col("dep") - 1).alias("x")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if out is None:
        return m.cols.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    total = out.groupBy("node").agg(F.sum("x").alias("x"))
    return m.cols.join(total, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("x", F.lit(0.0)).alias("score"))


def clustering_coefficient(m: Matrix) -> DataFrame:
    """(node, clcf): closed neighbour pairs over all ordered ones; 0 below two neighbours.

    Wedges are made only at the arc's end of smaller degree (ties by id), so a
    hub never emits the square of its degree.
    """
    e = materialize(edges_of(m))
    deg = e.groupBy("a").agg(F.count("*").alias("d"))
    d1, d2 = (deg.select(F.col("a").alias(f"n{i}"), F.col("d").alias(f"d{i}")) for i in (1, 2))
    f = e.join(d1, F.col("a") == F.col("n1")).join(d2, F.col("b") == F.col("n2")).where("d1 < d2 OR (d1 = d2 AND a < b)").select("a", "b")
    x, y = f.select(F.col("a").alias("o"), F.col("b").alias("p")), f.select(F.col("a").alias("o2"), F.col("b").alias("q"))
    wedge = x.join(y, (F.col("o") == F.col("o2")) & (F.col("p") < F.col("q"))).select("o", "p", "q")
    tri = wedge.join(e, (F.col("p") == F.col("a")) & (F.col("q") == F.col("b"))).select(F.explode(F.array("o", "p", "q")).alias("t"))
    per = tri.groupBy("t").agg((F.count("*") * 2).alias("closed"))
    out = m.cols.join(deg, F.col("id") == F.col("a"), "left").join(per, F.col("id") == F.col("t"), "left")
    pairs = F.coalesce("d", F.lit(0)) * (F.coalesce("d", F.lit(0)) - 1)
    return out.select(F.col("id").alias("node"), F.when(pairs > 0, F.coalesce("closed", F.lit(0)) / pairs).otherwise(0.0).alias("clcf"))


def path_lattice(m: Matrix, a: int, b: int) -> DataFrame:
    """(layer, node): all nodes on shortest paths from ``a`` to ``b`` by their distance from ``a``; empty if there is none."""
    spark = m.cells.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "id bigint")
    da = distances(m, domain_meet(one(a), m.cols)).select(F.col("node").alias("n"), F.col("dist").alias("x"))
    db = distances(m, domain_meet(one(b), m.cols)).select("node", F.col("dist").alias("y"))
    j = da.join(db, F.col("n") == F.col("node"))
    length = j.where(F.col("node") == b).agg(F.max("x").alias("length"))
    return j.join(F.broadcast(length), F.col("x") + F.col("y") == F.col("length")).select(F.col("x").alias("layer"), "node")


def path_steps(m: Matrix, a: int, b: int) -> DataFrame:
    """(layer, tail, head): the arcs between consecutive layers of ``path_lattice``."""
    lat = materialize(path_lattice(m, a, b))
    h = lat.select((F.col("layer") - 1).alias("l2"), F.col("node").alias("head"))
    e = edges_of(m)
    return lat.join(e, F.col("node") == F.col("a")).join(h, (F.col("b") == F.col("head")) & (F.col("layer") == F.col("l2"))).select("layer", F.col("node").alias("tail"), "head")


def path_nodes(m: Matrix, ids: DataFrame) -> DataFrame:
    """(id): nodes on shortest paths between any two of ``ids``, which are a few."""
    d = materialize(distances(m, ids))
    x = d.select(F.col("src").alias("s"), "node", F.col("dist").alias("x"))
    y = d.select(F.col("src").alias("t"), F.col("node").alias("n2"), F.col("dist").alias("y"))
    far = d.join(ids.select(F.col("id").alias("i")), F.col("node") == F.col("i"), "left_semi").select(F.col("src").alias("fs"), F.col("node").alias("ft"), F.col("dist").alias("len"))
    j = x.join(y, (F.col("node") == F.col("n2")) & (F.col("s") < F.col("t"))).join(far, (F.col("s") == F.col("fs")) & (F.col("t") == F.col("ft")))
    return j.where("x + y = len").select(F.col("node").alias("id")).distinct()


def top_degree(m: Matrix, n: int) -> DataFrame:
    """(node, degree): the n nodes of highest degree, ties to the smaller id."""
    return m.cells.groupBy(F.col("col_id").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(n)


def neighbours(m: Matrix, node: int) -> DataFrame:
    return m.cells.where(F.col("col_id") == node).select(F.col("row_id").alias("node"), "val")


def on_cycles(m: Matrix) -> DataFrame:
    """(id): nodes left when nodes without predecessors and nodes without successors are taken away again and again."""
    e = materialize(arcs_of(m).distinct())
    n = e.count()
    while True:
        heads, tails = domain(e, "b").withColumnRenamed("id", "_h"), domain(e, "a").withColumnRenamed("id", "_t")
        kept = materialize(e.join(heads, F.col("a") == F.col("_h"), "left_semi").join(tails, F.col("b") == F.col("_t"), "left_semi"))
        k = kept.count()
        release(m.cells.sparkSession, e)
        e = kept
        if k == n:
            return domain(e, "a")
        n = k


def reachable(m: Matrix, ids: DataFrame) -> DataFrame:
    """(src, node): nodes reached along arcs."""
    return distances(m, ids, directed=True).where("dist > 0").select("src", "node")


def weight_histogram(m: Matrix, start: float, width: float, bins: int) -> DataFrame:
    """(bin, n): arcs by weight, ends open."""
    b = F.least(F.greatest(F.floor((F.col("val") - start) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return m.cells.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def dimensions(m: Matrix) -> DataFrame:
    n = lambda d, c: d.agg(F.count("*").alias(c))
    return n(m.cols, "n_cols").join(n(m.rows, "n_rows")).join(n(m.cells, "n_cells"))


def node_attributes(m: Matrix) -> DataFrame:
    """(node, degree, mean, least, top, median) over each node's arcs without its loop."""
    s = m.cells.where("col_id <> row_id").groupBy("col_id").agg(F.count("*").alias("degree"), F.avg("val").alias("mean"), F.min("val").alias("least"), F.max("val").alias("top"), F.percentile("val", F.lit(0.5)).alias("median"))
    return m.cols.join(s, F.col("id") == F.col("col_id"), "left").select(F.col("id").alias("node"), F.coalesce("degree", F.lit(0)).alias("degree"), "mean", "least", "top", "median")


def sweep(m: Matrix, steps: list[tuple[float, Callable[[Matrix], Matrix]]]) -> DataFrame:
    """A row for each step (value, transform): nodes, components, singletons, largest component, Σ size² / N, arcs, mean, median and interquartile range of weights, mean and median degree, mean clustering coefficient.

    The steps are a handful of parameters; each is one pass over the written arcs.
    """
    base = Matrix(materialize(m.cells), materialize(m.cols), m.cols)
    out = None
    for value, change in steps:
        g = change(base)
        g = Matrix(materialize(g.cells), base.cols, base.cols)
        comp = components(g).groupBy("component").agg(F.count("*").alias("n"))
        s = comp.agg(F.sum("n").alias("nodes"), F.count("*").alias("components"), F.sum((F.col("n") == 1).cast("bigint")).alias("singletons"), F.max("n").alias("largest"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("spread"))
        q = lambda x: F.percentile("val", F.lit(x))
        w = g.cells.where("col_id <> row_id").agg(F.count("*").alias("arcs"), F.avg("val").alias("mean_weight"), q(0.5).alias("median_weight"), (q(0.75) - q(0.25)).alias("iqr_weight"))
        d = node_attributes(g).agg(F.avg("degree").alias("mean_degree"), F.percentile("degree", F.lit(0.5)).alias("median_degree"))
        c = clustering_coefficient(g).agg(F.avg("clcf").alias("clcf"))
        row = s.join(w).join(d).join(c).withColumn("step", F.lit(float(value)))
        out = row if out is None else out.unionByName(row)
    return out


def sweep_thresholds(m: Matrix, cutoffs: list[float]) -> DataFrame:
    """``sweep`` over graphs of arcs at least as heavy as each cutoff."""
    return sweep(m, [(c, lambda g, c=c: g.put(g.cells.where(F.col("val") >= c))) for c in cutoffs])


def sweep_knn(m: Matrix, ks: list[int]) -> DataFrame:
    """``sweep`` over graphs of mutual k nearest neighbours."""
    from gridloom.operators.aggregates import knn

    return sweep(m, [(k, lambda g, k=k: knn(g, k)) for k in ks])


def sweep_ceil(m: Matrix, caps: list[int]) -> DataFrame:
    """``sweep`` over graphs whose nodes keep at most so many arcs."""
    from gridloom.operators.aggregates import ceil_neighbours

    return sweep(m, [(k, lambda g, k=k: ceil_neighbours(g, k)) for k in caps])


def threshold_components(pairs: DataFrame, cutoff: float) -> DataFrame:
    """(component, node) of the single-linkage tree over (a, b, val) cut at ``cutoff``: components of pairs at least that similar."""
    cells = pairs.where(F.col("val") >= cutoff).select(F.col("a").alias("col_id"), F.col("b").alias("row_id"), "val")
    return components(Matrix.graph(cells, domain(pairs, "a", "b")))


def adamic_adar(m: Matrix) -> Matrix:
    """Σ log 2 / log degree over common neighbours of connected pairs; each arc then takes the larger of that and the reverse arc's present value."""
    from gridloom.operators.setops import binary

    e = materialize(edges_of(m))
    deg = e.groupBy("a").agg(F.count("*").alias("d"))
    x = e.select(F.col("a").alias("u"), F.col("b").alias("w"))
    y = e.select(F.col("b").alias("w2"), F.col("a").alias("v"))
    close = m.cells.where("col_id < row_id")
    z = close.join(x, F.col("col_id") == F.col("u")).join(y.select("w2", "v"), (F.col("w") == F.col("w2")) & (F.col("row_id") == F.col("v")))
    s = z.join(deg, F.col("w") == F.col("a")).groupBy("col_id", "row_id").agg(F.sum(F.log(F.lit(2.0)) / F.log("d")).alias("val"))
    half = Matrix(s, m.cols, m.rows)
    rest = m.put(m.cells.where("col_id > row_id"))
    both = binary(half, rest, "add")
    return binary(both, both.t, "max")


def neighbour_cosine(m: Matrix) -> DataFrame:
    """(col_id, row_id, val): for connected pairs, the cosine of their columns."""
    n = m.cells.groupBy("col_id").agg(F.sum(F.col("val") * F.col("val")).alias("q"))
    a = m.cells.select(F.col("col_id").alias("u"), F.col("row_id").alias("k"), F.col("val").alias("x"))
    b = m.cells.select(F.col("col_id").alias("v"), F.col("row_id").alias("k2"), F.col("val").alias("y"))
    arcs = m.cells.where("col_id <> row_id").select("col_id", "row_id")
    dot = arcs.join(a, F.col("col_id") == F.col("u")).join(b, (F.col("row_id") == F.col("v")) & (F.col("k") == F.col("k2"))).groupBy("col_id", "row_id").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    q1, q2 = (n.select(F.col("col_id").alias(f"n{i}"), F.col("q").alias(f"q{i}")) for i in (1, 2))
    return dot.join(q1, F.col("col_id") == F.col("n1")).join(q2, F.col("row_id") == F.col("n2")).select("col_id", "row_id", (F.col("d") / F.sqrt(F.col("q1") * F.col("q2"))).alias("val"))


def tug(m: Matrix, radius: float = 1000.0) -> Matrix:
    """Weights nudged by a fraction of the neighbours' cosine: val * (1 + cosine * radius * 1e-7)."""
    c = neighbour_cosine(m).select(F.col("col_id").alias("_x"), F.col("row_id").alias("_y"), F.col("val").alias("_q"))
    out = m.cells.join(c, (F.col("col_id") == F.col("_x")) & (F.col("row_id") == F.col("_y")), "left")
    return m.put(out.select("col_id", "row_id", (F.col("val") * (1 + F.coalesce("_q", F.lit(0.0)) * radius * 1e-7)).alias("val")))


def shrug(m: Matrix, radius: float = 1000.0, seed: int = 1) -> Matrix:
    """Weights nudged at random within the same range."""
    return m.put(m.cells.withColumn("val", F.col("val") * (1 + F.rand(seed) * radius * 1e-7)))


def layers(df: DataFrame) -> DataFrame:
    """(layer, n) of a path lattice."""
    return df.groupBy("layer").agg(F.count("*").alias("n"))


def degree_rank_fit(m: Matrix) -> DataFrame:
    """One row: r² of log degree against log number of nodes of that degree."""
    d = m.cells.groupBy("col_id").agg(F.count("*").alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    return d.agg(F.pow(F.corr(F.log("d"), F.log("n")), F.lit(2.0)).alias("r2"))


def sorted_weights(m: Matrix) -> DataFrame:
    """(val, n, position): distinct weights in descending order, how often each occurs and the position of its first occurrence."""
    g = m.cells.groupBy("val").agg(F.count("*").alias("n"))
    return running(g, [F.desc("val")], "n").select("val", "n", (F.col("before") + 1).alias("position"))
