"""From raw lines to labelled clusters in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.matrix import Matrix
from gridloom.operators import clusters, hierarchy
from gridloom.operators.flow import Flow, cluster
from gridloom.plans import transform
from gridloom.sources import streams, tables


def cluster_arcs(arcs: DataFrame, flow: Flow = Flow(), spec: str = "", symmetric: str = "max", repeats: str = "max") -> DataFrame:
    """(cluster, label) of arcs (x, y, val): loaded, symmetrised, transformed by ``spec``, clustered. Clusters are named by the label of their smallest id."""
    got = streams.load(arcs, repeats=repeats, symmetric=symmetric)
    m = transform.run(got.matrix, spec) if spec else got.matrix
    cl = cluster(m, flow)
    own = got.col_tab.select(F.col("id").alias("_n"), "label")
    head = got.col_tab.select(F.col("id").alias("_c"), F.col("label").alias("name"))
    return cl.join(own, F.col("node") == F.col("_n")).join(head, F.col("cluster") == F.col("_c")).select(F.col("name").alias("cluster"), "label")


def cluster_lines(lines: DataFrame, **how) -> DataFrame:
    """``cluster_arcs`` of label lines (``value``)."""
    return cluster_arcs(streams.read_abc(lines), **how)


def cluster_alignments(lines: DataFrame, score: str = "e", cut: float = 0.0, **how) -> DataFrame:
    """``cluster_arcs`` of tabular alignments, by default on their E values with the best of repeats."""
    return cluster_arcs(tables.read_alignments(lines, score, cut), **how)


def label_lines(cl: DataFrame, sep: str = "\t") -> DataFrame:
    """(cluster, size, line): a line of labels a cluster, in label order."""
    g = cl.groupBy("cluster").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("label")), sep).alias("line"))
    return g.select("cluster", "size", "line")


def coarsen(m: Matrix, inflations: list[float], scheme: int = 6) -> DataFrame:
    """A nested stack out of independent runs at several inflations, finest first."""
    return hierarchy.integrate([cluster(m, Flow(inflation=i, scheme=scheme)) for i in inflations])


def subcluster(m: Matrix, cl: DataFrame, flow: Flow = Flow()) -> DataFrame:
    """One level finer: the graph of arcs within clusters is clustered again, so that parts never cross."""
    from gridloom.operators.reshape import block_union

    return clusters.meet(cl, cluster(block_union(m, cl), flow))
