import math

import pytest

from gridloom.functions import edge
from gridloom.operators import aggregates, reshape


def test_zero_rule_and_clamps(graph, as_dict):
    m = graph({(0, 1): 1, (0, 2): 2, (0, 3): 4}, range(4))
    assert as_dict(edge.unary(m, edge.add(-2))) == {(0, 1): -1, (0, 3): 2}
    assert as_dict(edge.unary(m, edge.log())) == pytest.approx({(0, 2): math.log(2), (0, 3): math.log(4)})
    assert as_dict(edge.unary(m, edge.ceil(2.5))) == {(0, 1): 1, (0, 2): 2, (0, 3): 2.5}
    assert as_dict(edge.unary(m, edge.floor(2.5))) == {(0, 1): 2.5, (0, 2): 2.5, (0, 3): 4}
    assert as_dict(edge.unary(m, edge.scale(0))) == {}
    # a weight gone at one step is gone for the next
    assert as_dict(edge.unary(m, edge.gq(2), edge.add(1))) == {(0, 2): 3, (0, 3): 5}


def test_top_k_ties(graph, as_dict):
    m = graph({(0, 1): 3, (0, 2): 2, (0, 3): 2, (0, 4): 1}, range(5))
    assert set(as_dict(aggregates.top_k(m, 2))) == {(0, 1)}
    assert set(as_dict(aggregates.top_k(m, 2, "keep"))) == {(0, 1), (0, 2), (0, 3)}
    assert set(as_dict(aggregates.top_k(m, 2, "above"))) == {(0, 1)}
    assert set(as_dict(aggregates.top_k(m, 9))) == set(as_dict(m))
    assert as_dict(aggregates.quantiles(m, 0.25)) == {(0, 1): 3}


def test_columns_sum_to_one_and_empty_columns_stay(graph):
    m = graph({(0, 1): 3, (0, 2): 1, (2, 0): 5}, range(4))
    sums = {r.col_id: r.total for r in aggregates.column_stats(aggregates.inflate(m, 2)).collect()}
    assert sums == pytest.approx({0: 1, 1: 0, 2: 1, 3: 0})


def test_loops(graph, as_dict):
    m = graph({(0, 1): 3, (1, 0): 3, (0, 0): 9}, range(3))
    assert as_dict(reshape.set_loops(m, "max")) == {(0, 1): 3, (1, 0): 3, (0, 0): 3, (1, 1): 3, (2, 2): 1}
    assert as_dict(reshape.set_loops(m, "empty"))[(2, 2)] == 1
    assert as_dict(reshape.drop_loops(m)) == {(0, 1): 3, (1, 0): 3}


def test_ranks_average_ties(graph):
    m = graph({(0, 1): 5, (0, 2): 5, (0, 3): 1, (0, 4): 7}, range(5))
    assert {r.row_id: r.val for r in aggregates.ranks(m.cells).collect()} == {3: 1, 1: 2.5, 2: 2.5, 4: 4}


def test_ceil_neighbours_against_plain_python(graph, as_dict):
    import random

    r = random.Random(2)
    cells = {}
    for _ in range(60):
        a, b = r.randrange(12), r.randrange(12)
        if a != b:
            cells[a, b] = cells[b, a] = round(r.uniform(0, 9), 3)
    near = {}
    for (a, b), v in cells.items():
        near.setdefault(a, {})[b] = v
    for c in sorted(near, key=lambda x: (-len(near[x]), x)):
        for b in sorted(near[c], key=lambda x: (-near[c][x], x))[4:]:
            del near[c][b]
            near[b].pop(c, None)
    want = {(a, b): v for a in near for b, v in near[a].items()}
    assert as_dict(aggregates.ceil_neighbours(graph(cells, range(12)), 4)) == want


def test_blocks_and_folding(graph, as_dict, spark):
    m = graph({(0, 1): 1, (1, 2): 2, (2, 0): 3}, range(3))
    cl = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "cluster bigint, node bigint")
    assert as_dict(reshape.block_union(m, cl)) == {(0, 1): 1, (1, 2): 2}
    assert as_dict(reshape.block_union(m, cl, inside=False)) == {(2, 0): 3}
    dup = spark.createDataFrame([(2, 1), (1, 1)], "node bigint, representative bigint")
    assert as_dict(reshape.fold(m, dup)) == {(0, 1): 3, (1, 0): 3, (1, 1): 2}


def test_extreme_domains(graph, as_dict):
    empty = graph({}, [])
    nodes_only = graph({}, range(9))
    for m in (empty, nodes_only):
        assert as_dict(aggregates.inflate(m, 2)) == {}
        assert as_dict(aggregates.knn(m, 3)) == {}
        assert aggregates.column_stats(m).count() == m.cols.count()
        assert as_dict(m.t) == {}
