"""The sub-matrix language: ``dom(c, i(0-9,12)), size(gq(2)), fin(scrub)`` and so on.

A specification is parsed once into named parts, which then run in a fixed
order: domains, paths and extensions, the cut, weights, sizes, final actions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.matrix import Matrix
from gridloom.operators import graphs, reshape, setops
from gridloom.operators.aggregates import column_stats
from gridloom.plans import transform

Node = tuple[str, list["Node"]]


def parse(spec: str) -> list[Node]:
    """Nested ``name(args)`` and bare words, comma separated, as (name, args)."""
    tokens = re.findall(r"[(),]|[^(),\s]+", spec)
    at = 0

    def items() -> list[Node]:
        nonlocal at
        out: list[Node] = []
        while at < len(tokens) and tokens[at] != ")":
            if tokens[at] == ",":
                at += 1
                continue
            if tokens[at] == "(":
                raise ValueError("unexpected parenthesis")
            name = tokens[at]
            at += 1
            args: list[Node] = []
            if at < len(tokens) and tokens[at] == "(":
                at += 1
                args = items()
                if at >= len(tokens):
                    raise ValueError("missing closing parenthesis")
                at += 1
            out.append((name, args))
        return out

    out = items()
    if at != len(tokens):
        raise ValueError("unexpected closing parenthesis")
    return out


def id_list(args: list[Node]) -> list[tuple[int, int]]:
    """Inclusive ranges of a list such as ``2,5,4-8``."""
    out = []
    for name, _ in args:
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", name)
        if not m:
            raise ValueError(f"not an id or a range: {name!r}")
        out.append((int(m[1]), int(m[2] or m[1])))
    return out


def _listed(universe: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    hit = F.lit(False)
    for a, b in ranges:
        hit = hit | F.col("id").between(a, b)
    return universe.where(hit)


@dataclass(frozen=True)
class Context:
    """What a specification may refer to besides its matrix: clusters (cluster, node) for ``d``, a tab (id, label) for ``t``."""

    clusters: DataFrame | None = None
    tab: DataFrame | None = None


def _domain(universe: DataFrame, m: Matrix, args: list[Node], ctx: Context) -> DataFrame:
    """The union of the selections in ``args`` within ``universe``; capital letters select the complement."""
    out = None
    for name, sub in args:
        key = name.lower()
        if key == "i":
            one = _listed(universe, id_list(sub))
        elif key == "d":
            if ctx.clusters is None:
                raise ValueError("d() needs clusters")
            nodes = ctx.clusters if not sub else _listed(ctx.clusters.withColumnRenamed("cluster", "id"), id_list(sub))
            one = setops.domain_meet(universe, nodes.select(F.col("node").alias("id")).distinct())
        elif key in ("c", "r"):
            one = setops.domain_meet(universe, m.cols if key == "c" else m.rows)
        elif key == "t":
            if ctx.tab is None:
                raise ValueError("t needs a tab")
            one = setops.domain_meet(universe, ctx.tab.select("id").distinct())
        else:
            raise ValueError(f"unknown selection {name!r}")
        if name[0].isupper():
            one = setops.domain_minus(universe, one)
        out = one if out is None else setops.union_domain(out, one)
    return universe if out is None else out


def run(m: Matrix, spec: str, ctx: Context = Context(), extend: bool = False, edge_share: float | None = None, seed: int = 1) -> Matrix:
    """The sub-matrix of one specification.

    ``dom(c|r|cr, ...)`` selects domains, ``path(ids)`` adds nodes on shortest
    paths between ids, ``ext(disc(k)|cdisc(k)|rdisc(k)|ring(k))`` widens by k
    steps (a ring keeps only the last one), ``val(program)`` changes weights,
    ``size(gq(a),lq(b),ceil(c))`` bounds degrees, ``fin(...)`` ends with skel,
    tp, cc, uni, scrub..., map... and so on.
    """
    parts = parse(spec)
    cols, rows = m.cols, m.rows
    actions: list[str] = []
    values, bounds = "", {}
    chosen = False
    for name, args in parts:
        if name == "dom":
            which = args[0][0] if args else "cr"
            if "c" in which:
                cols = _domain(m.cols, m, args[1:], ctx)
            if "r" in which:
                rows = _domain(m.rows, m, args[1:], ctx)
            chosen = True
        elif name == "path":
            ids = _listed(m.cols, id_list(args))
            cols = rows = graphs.path_nodes(m, ids)
            chosen = True
        elif name == "ext":
            for kind, sub in args:
                k = int(sub[0][0]) if sub else 1
                if kind == "ring":
                    d = graphs.distances(m, cols, k)
                    far = d.groupBy("node").agg(F.min("dist").alias("d")).where(F.col("d") == k)
                    cols = rows = far.select(F.col("node").alias("id"))
                    continue
                wide = graphs.disc(m, cols if kind != "rdisc" else rows, k)
                if kind in ("disc", "cdisc"):
                    cols = wide
                if kind in ("disc", "rdisc"):
                    rows = wide
            chosen = True
        elif name == "val":
            values = ",".join(f"{n}({a[0][0] if a else ''})" for n, a in args)
        elif name == "size":
            bounds = {n: int(a[0][0]) for n, a in args}
        elif name == "fin":
            actions = [n for n, _ in args]
        elif name != "out":
            raise ValueError(f"unknown part {name!r}")
    source = m
    if "skel" in actions:
        m = Matrix(m.cells.where(F.lit(False)), cols, rows)
    elif extend:
        m = reshape.extended_sub(m, cols, rows)
    elif chosen:
        m = reshape.sub(m, cols, rows)
    if values:
        m = transform.run(m, values, graph_ops=False)
    if bounds:
        s = column_stats(m).select(F.col("col_id").alias("id"), "n")
        if "gq" in bounds:
            s = s.where(F.col("n") >= bounds["gq"])
        if "lq" in bounds:
            s = s.where(F.col("n") <= bounds["lq"])
        m = reshape.sub(m, cols=s.select("id"))
        if "ceil" in bounds:
            from gridloom.operators.aggregates import top_k

            m = top_k(m, bounds["ceil"])
    if edge_share is not None:
        m = m.put(m.cells.where(F.rand(seed) < edge_share))
    for a in actions:
        if a == "uni":
            m = Matrix(m.cells, source.cols, source.rows)
        elif a == "unic":
            m = Matrix(m.cells, source.cols, m.rows)
        elif a == "unir":
            m = Matrix(m.cells, m.cols, source.rows)
        elif a == "tp":
            m = m.t
        elif a == "cc":
            m = reshape.characteristic(m)
        elif a in ("scrub", "scrubc", "scrubr", "scrubg"):
            m = reshape.scrub(m, {"scrub": "both", "scrubc": "cols", "scrubr": "rows", "scrubg": "graph"}[a])
        elif a in ("map", "mapc", "mapr"):
            m = reshape.map_ids(m, reshape.canonical_map(m.cols) if a != "mapr" else None, reshape.canonical_map(m.rows) if a != "mapc" else None)
        elif a in ("vdoms", "vdomc", "vdomr"):
            v = lambda d: setops.diagonal(d.withColumn("val", F.lit(1.0)))
            m = v(m.rows if a == "vdomr" else m.cols)
        elif a != "skel":
            raise ValueError(f"unknown action {a!r}")
    return m


def sample_domain(dom: DataFrame, share: float, how: str = "intersect", seed: int = 1, universe: DataFrame | None = None) -> DataFrame:
    """A domain combined with a random selection of ``universe`` (by default itself): intersect, merge, discard or exclusive."""
    u = dom if universe is None else universe
    pick = u.where(F.xxhash64(F.lit(seed), "id") % 1_000_000 < F.lit(int(share * 1_000_000) * 2 - 1_000_000 if share < 1 else 1_000_000))
    if how == "merge":
        return setops.union_domain(dom, pick)
    if how == "discard":
        return setops.domain_minus(dom, pick)
    if how == "exclusive":
        return setops.domain_minus(pick, dom)
    return setops.domain_meet(dom, pick)
