from collections import deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gridloom.operators import flow, graphs, hierarchy
from gridloom.operators import clusters as cl


def _sym(edges):
    return {k: 1.0 for a, b in edges for k in ((a, b), (b, a))}


# the Petersen graph: outer cycle, spokes, inner star
PETERSEN = _sym([(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)])


def _bfs(adj, s):
    d, q = {s: 0}, deque([s])
    while q:
        u = q.popleft()
        for v in adj.get(u, ()):
            if v not in d:
                d[v] = d[u] + 1
                q.append(v)
    return d


def _adj(cells):
    adj = {}
    for a, b in cells:
        adj.setdefault(a, set()).add(b)
    return adj


def test_measures_of_the_petersen_graph(graph):
    m = graph(PETERSEN, range(10))
    assert {r.ecc for r in graphs.eccentricity(m).collect()} == {2}
    assert {r.clcf for r in graphs.clustering_coefficient(m).collect()} == {0.0}
    assert graphs.components(m).select("component").distinct().count() == 1
    # every pair at distance two has one shortest path, its middle scores once a direction
    scores = [r.score for r in graphs.betweenness(m).collect()]
    assert scores == pytest.approx([6.0] * 10)


def test_components_of_a_long_path_and_loose_nodes(graph):
    m = graph(_sym([(i, i + 1) for i in range(40)]), range(50))
    got = {r.node: r.component for r in graphs.components(m).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: i for i in range(41, 50)}}


def test_betweenness_and_distances_against_plain_search(graph):
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (4, 5), (5, 6), (6, 4), (7, 8)]
    cells = _sym(edges)
    adj = _adj(cells)
    m = graph(cells, range(10))
    dist = {(r.src, r.node): r.dist for r in graphs.distances(m, m.cols).collect()}
    want = {(s, v): d for s in range(10) for v, d in _bfs(adj, s).items()}
    assert dist == want

    def paths(s, t):
        out, q = [], [[s]]
        while q:
            p = q.pop()
            if p[-1] == t:
                out.append(p)
                continue
            q += [p + [v] for v in adj[p[-1]] if want.get((s, v)) == len(p) and (v, t) in want and len(p) + want[v, t] == want[s, t]]
        return out

    score = {i: 0.0 for i in range(10)}
    for s in adj:
        for t in adj:
            if s != t and (s, t) in want:
                ps = paths(s, t)
                for p in ps:
                    for v in p[1:-1]:
                        score[v] += 1 / len(ps)
    assert {r.node: r.score for r in graphs.betweenness(m).collect()} == pytest.approx(score)
    assert {(r.layer, r.node) for r in graphs.path_lattice(m, 0, 4).collect()} == {(0, 0), (1, 1), (1, 3), (2, 2), (3, 4)}
    assert graphs.path_lattice(m, 0, 8).count() == 0
    assert {(r.layer, r.tail, r.head) for r in graphs.path_steps(m, 0, 2).collect()} == {(0, 0, 1), (0, 0, 3), (1, 1, 2), (1, 3, 2)}


def test_clustering_coefficient_against_triangles(graph):
    edges = list(combinations(range(5), 2)) + [(0, 5), (5, 6), (1, 6)]
    cells = _sym(edges)
    adj = _adj(cells)
    want = {v: sum(b in adj[a] for a in adj[v] for b in adj[v]) / (len(adj[v]) * (len(adj[v]) - 1)) for v in adj}
    assert {r.node: r.clcf for r in graphs.clustering_coefficient(graph(cells)).collect()} == pytest.approx(want)


def test_cycles(graph):
    m = graph({(0, 1): 1, (1, 2): 1, (2, 1): 1, (2, 3): 1, (3, 4): 1}, range(5))
    assert {r.id for r in graphs.on_cycles(m).collect()} == {1, 2}
    assert graphs.on_cycles(graph({(0, 1): 1}, range(2))).count() == 0


# fixed values: a 12-node graph on scattered ids and its three clusters
IDS = [11, 22, 33, 44, 55, 66, 77, 88, 99, 123, 456, 2147483647]
NEAR = {0: [1, 5, 6, 9], 1: [0, 2, 4], 2: [1, 3, 4], 3: [2, 7, 8, 10], 4: [1, 2, 6, 7], 5: [0, 9], 6: [0, 4, 9], 7: [3, 4, 8, 10], 8: [3, 7, 10, 11], 9: [0, 5, 6], 10: [3, 7, 8, 11], 11: [8, 10]}
CLUSTERS = {frozenset({44, 88, 99, 456, 2147483647}), frozenset({11, 66, 77, 123}), frozenset({22, 33, 55})}


def _sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.node)
    return {frozenset(v) for v in out.values()}


def test_flow_clusters_of_the_twelve_node_graph(graph):
    m = graph({(IDS[a], IDS[b]): 1.0 for a in NEAR for b in NEAR[a]}, IDS)
    assert _sets(flow.cluster(m)) == CLUSTERS


def test_flow_keeps_loose_nodes_and_is_a_partition(graph):
    m = graph(_sym([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]), range(8))
    got = _sets(flow.cluster(m))
    assert got == {frozenset({0, 1, 2}), frozenset({3, 4, 5}), frozenset({6}), frozenset({7})}


def test_pruning_selects_and_recovers(graph):
    cells = {(0, i): v for i, v in enumerate([0.4, 0.25, 0.15, 0.1, 0.06, 0.04])}
    m = graph(cells, range(6))
    assert {r.row_id for r in flow.prune(m, 0.08, 0, 0).where("col_id = 0").collect()} == {0, 1, 2, 3}
    assert {r.row_id for r in flow.prune(m, 0.08, 2, 0).where("col_id = 0").collect()} == {0, 1}
    assert {r.row_id for r in flow.prune(m, 0.3, 0, 3, 0.9).where("col_id = 0").collect()} == {0, 1, 2}
    total = flow.prune(m, 0.08, 2, 0).where("col_id = 0").agg(F.sum("val")).first()[0]
    assert total == pytest.approx(1)


def test_partition_distances(spark):
    p = lambda *g: spark.createDataFrame([(i, n) for i, x in enumerate(g) for n in x], "cluster bigint, node bigint")
    a, b = p((1, 2, 3), (4, 5)), p((1, 2), (3, 4, 5))
    same = cl.compare(a, a).first()
    assert (same.split_a, same.split_b, same.vi_a, same.mirkin_a, same.jaccard, same.rand) == (0, 0, 0, 0, 1, 1)
    x, y = cl.compare(a, b).first(), cl.compare(b, a).first()
    assert (x.split_a, x.split_b) == (y.split_b, y.split_a) == (1, 1)
    assert x.vi_a == pytest.approx(y.vi_b) and x.mirkin_a == y.mirkin_b == 4


@pytest.mark.parametrize("mode,want", [("cut", {frozenset({1, 2, 3}), frozenset({4, 5}), frozenset({6})}), ("split", {frozenset({1, 2}), frozenset({3}), frozenset({4, 5}), frozenset({6})})])
def test_enstrict_makes_a_partition(spark, mode, want):
    c = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 3), (1, 4), (1, 5)], "cluster bigint, node bigint")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id bigint")
    assert _sets(cl.enstrict(c, nodes, mode)) == want
    d = cl.defects(c, nodes).first()
    assert (d.clusters, d.missing, d.overlap) == (2, 1, 1)


def test_stack_cone_and_newick(spark):
    h = spark.createDataFrame([(0, 10, 1), (0, 10, 2), (0, 20, 3), (0, 30, 4), (1, 100, 1), (1, 100, 2), (1, 100, 3), (1, 200, 4)], "level int, cluster bigint, node bigint")
    cone = hierarchy.conify(h)
    assert {tuple(r) for r in cone.where("level = 1").collect()} == {(1, 100, 10), (1, 100, 20), (1, 200, 30)}
    assert {tuple(r) for r in hierarchy.unconify(cone).collect()} == {tuple(r) for r in h.collect()}
    assert hierarchy.is_nested(h) and hierarchy.has_one_domain(h)
    trees = {r.cluster: r.tree for r in hierarchy.newick(cone, lengths=False).collect()}
    assert trees == {100: "((1,2),(3));", 200: "((4));"}


def test_contraction_gives_a_nested_cone(graph):
    blocks = [list(range(i * 4, i * 4 + 4)) for i in range(3)]
    edges = [e for b in blocks for e in combinations(b, 2)] + [(0, 4), (4, 8)]
    h = hierarchy.contract(graph(_sym(edges), range(12)), root=True)
    assert _sets(hierarchy.level(h, 0)) == {frozenset(b) for b in blocks}
    assert hierarchy.is_nested(hierarchy.unconify(h))


def test_part_queries_take_every_common_order(spark, monkeypatch):
    """Of the 17,798 arcs of sf0.001, 4,648 stand for two common orders or more."""
    from conftest import SF

    from gridloom import queries

    monkeypatch.setattr(queries.flow, "cluster", lambda m, f: m.cells)
    monkeypatch.setattr(queries.aggregates, "ceil_neighbours", lambda m, most: m)
    assert queries.flow_clusters(spark, SF).count() == 17_798
    assert queries.ceil_neighbours(spark, SF).count() == 17_798


def test_bounds_reached_are_errors(graph, monkeypatch):
    from gridloom.operators import graphs as ops

    path = graph(_sym([(i, i + 1) for i in range(7)]), range(8))
    with pytest.raises(RuntimeError, match="settle"):
        flow.limit(flow.prepare(path), flow.Flow(most=1))
    with pytest.raises(RuntimeError, match="levels"):
        hierarchy.contract(path, most=1)
    one = path.cols.where("id = 0")
    monkeypatch.setattr(ops, "MAX_ROUNDS", 3)
    with pytest.raises(RuntimeError, match="reach"):
        ops.distances(path, one)
    assert ops.distances(path, one, 3).count() == 4


@pytest.mark.parametrize("local", [1 << 22, 1])
def test_components_in_one_task_and_in_rounds(graph, monkeypatch, local):
    monkeypatch.setattr(graphs, "LOCAL_EDGES", local)
    if local > 1:
        monkeypatch.setattr(graphs, "MAX_ROUNDS", 0)
    edges = [(7, 3), (3, 11), (11, 5), (20, 12), (12, 31), (31, 20), (40, 2), (40, 9), (40, 13), (9, 1)]
    m = graph(_sym(edges), [*range(15), 20, 31, 40])
    got = {r.node: r.component for r in graphs.components(m).collect()}
    want = {7: 3, 3: 3, 11: 3, 5: 3, 20: 12, 12: 12, 31: 12, 40: 1, 2: 1, 9: 1, 13: 1, 1: 1}
    assert got == {n: want.get(n, n) for n in [*range(15), 20, 31, 40]}
