"""The graph-transform language: a comma list of ``name(number)``.

Plain names change single weights and run as one projection; names with ``#``
change the graph. Both are lazy; a whole program is one plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable


from gridloom.functions.edge import OPS, Op, unary
from gridloom.matrix import Matrix
from gridloom.operators import aggregates, flow, graphs, reshape, setops

_TOKEN = re.compile(r"\s*(#?[a-z_-]+)\s*\(\s*([^()]*?)\s*\)\s*")
# fixed values: arguments of functions called without one
_DEFAULT = {"#step": 2.0, "#tug": 1000.0, "#shrug": 1000.0}
_NEED = {"#knn", "#ceilnb", "#mcl", "#arcmcl", "#qt", "#ssq", "#thread"}


def _clustered(both: bool) -> Callable[[Matrix, float | None], Matrix]:
    def f(m: Matrix, i: float | None) -> Matrix:
        g = setops.add_transpose(m, 0.5) if both else m
        return reshape.block_union(m, flow.cluster(g, flow.Flow(inflation=i or 2.0)))

    return f


def _graph_ops() -> dict[str, Callable[[Matrix, float | None], Matrix]]:
    ops: dict[str, Callable[[Matrix, float | None], Matrix]] = {
        "#add": lambda m, a: setops.merge_transpose(m, "add", 0.5),
        "#max": lambda m, a: setops.merge_transpose(m, "max"),
        "#min": lambda m, a: setops.merge_transpose(m, "min"),
        "#mul": lambda m, a: setops.merge_transpose(m, "mul"),
        "#arcmax": lambda m, a: setops.merge_transpose(m, "arcmax"),
        "#arcsub": lambda m, a: setops.merge_transpose(m, "arcsub"),
        "#tp": lambda m, a: m.t,
        "#rev": lambda m, a: m.t,
        "#selfrm": lambda m, a: reshape.drop_loops(m),
        "#selfmax": lambda m, a: reshape.set_loops(m, "max"),
        "#normself": lambda m, a: aggregates.norm_self(m),
        "#knn": lambda m, a: aggregates.knn(m, int(a)),
        "#ceilnb": lambda m, a: aggregates.ceil_neighbours(m, int(a)),
        "#ils": lambda m, a: graphs.adamic_adar(m),
        "#mcl": _clustered(False),
        "#arcmcl": _clustered(True),
        "#step": lambda m, a: setops.step(m, int(a)),
        "#qt": lambda m, a: aggregates.quantiles(m, a),
        "#ssq": lambda m, a: aggregates.ssq(m, a),
        "#tug": lambda m, a: graphs.tug(m, a),
        "#shrug": lambda m, a: graphs.shrug(m, a),
        "#thread": lambda m, a: m,
        "#shuffle": lambda m, a: m,
    }
    for kind in ("max", "min", "diff"):
        for cmp in ("gq", "gt", "lq", "lt"):
            ops[f"#arc{kind}{cmp}"] = lambda m, a, k=kind, c=cmp: setops.arc_select(m, k, c, a or 0.0)
    ops["#arcmimlq"] = ops["#arcminlq"]
    return ops


def parse(spec: str) -> list[tuple[str, float | None]]:
    """(name, argument) pairs; unknown names and missing arguments fail."""
    out, at, known = [], 0, _graph_ops()
    spec = spec.strip()
    while at < len(spec):
        t = _TOKEN.match(spec, at)
        if not t:
            raise ValueError(f"cannot read transform at {spec[at:]!r}")
        name, arg = t.group(1), t.group(2)
        if name not in OPS and name not in known:
            raise ValueError(f"unknown transform {name!r}")
        value = float(arg) if arg else _DEFAULT.get(name)
        if name in _NEED and value is None:
            raise ValueError(f"{name} needs a number")
        out.append((name, value))
        at = t.end()
        if at < len(spec):
            if spec[at] != ",":
                raise ValueError(f"expected a comma at {spec[at:]!r}")
            at += 1
    return out


def _op(name: str, arg: float | None) -> Op:
    return OPS[name]() if arg is None else OPS[name](arg)


def edge_ops(spec: str) -> list[Op]:
    """The single-weight functions of a program, for streams."""
    return [_op(n, a) for n, a in parse(spec) if n[0] != "#"]


def run(m: Matrix, spec: str, graph_ops: bool = True) -> Matrix:
    """Apply a program; ``graph_ops`` false skips the ``#`` functions."""
    known, waiting = _graph_ops(), []
    for name, arg in parse(spec):
        if name[0] != "#":
            waiting.append(_op(name, arg))
        elif graph_ops:
            if waiting:
                m, waiting = unary(m, *waiting), []
            m = known[name](m, arg)
    return unary(m, *waiting) if waiting else m


def describe(spec: str) -> str:
    return ", ".join(f"{n}({'' if a is None else a:g})" if a is not None else f"{n}()" for n, a in parse(spec))
