import random

import pytest

from gridloom.llm import groups, linkage

PAIRS = "x string, y string, val double"


def _union(rows):
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for x, y, v in rows:
        for z in (x, y):
            if z is not None:
                find(z)
        if x is not None and y is not None and v is not None and v >= 0.5:
            a, b = sorted((find(x), find(y)), key=lambda s: s.encode())
            up[b] = a
    return {z: find(z) for z in up}


def test_groups_against_union_find(spark):
    r = random.Random(9)
    names = [r.choice("aAzZé日") + str(i) for i in range(300)]
    rows = [(r.choice(names), r.choice(names), r.choice([0.2, 0.5, 0.9, None, float("nan")])) for _ in range(350)]
    rows += [(None, names[0], 0.9), (names[1], None, 0.9), (names[2], names[2], 0.9), (None, None, 1.0)] + rows[:30] + [(b, a, v) for a, b, v in rows[:30]]
    df = spark.createDataFrame([(*x, 1, "m") for x in rows], PAIRS + ", m int, label string")
    got = groups.group_records(df).collect()
    assert {r.label: r.group_label for r in got} == _union(rows)
    assert len(got) == len(_union(rows))


def test_long_chain_and_star(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}", 1.0) for i in range(200)]
    star = [("s", f"t{i}", 0.7) for i in range(300)]
    got = {r.label: r.group_label for r in groups.group_records(spark.createDataFrame(chain + star, PAIRS)).collect()}
    assert {got[f"c{i:04d}"] for i in range(201)} == {"c0000"}
    assert {got[f"t{i}"] for i in range(300)} == {"s"}


def test_crowded_minimum_is_looked_up_by_broadcast(spark, monkeypatch):
    from gridloom.plans import lookup

    r = random.Random(4)
    rows = [(f"a{i % 3}", f"b{i:03d}", 1.0) for i in range(240)] + [(f"b{r.randrange(240):03d}", f"c{i}", 1.0) for i in range(60)] + [("b000", "b001", 1.0), ("z1", "z2", 1.0)]
    df = spark.createDataFrame(rows, PAIRS)
    monkeypatch.setattr(lookup, "HEAVY_ROWS", 5)
    monkeypatch.setattr(lookup, "HEAVY_KEYS", 20)
    assert {r.label: r.group_label for r in groups.group_records(df).collect()} == _union(rows)


def test_no_links(spark):
    df = spark.createDataFrame([("a", "b", 0.1), ("b", None, 0.9)], PAIRS)
    assert {tuple(r) for r in groups.group_records(df).collect()} == {("a", "a"), ("b", "b")}
    assert groups.group_records(df.limit(0)).count() == 0


def _average_linkage(nodes, sim, stop):
    """Plain greedy average linkage."""
    cl = {n: [n] for n in nodes}
    avg = lambda a, b: sum(sim.get((min(x, y), max(x, y)), 0) for x in cl[a] for y in cl[b]) / len(cl[a]) / len(cl[b])
    while True:
        best = max(((avg(a, b), -a, -b) for a in cl for b in cl if a < b), default=None)
        if best is None or best[0] < stop:
            return {frozenset(v) for v in cl.values()}
        a, b = -best[1], -best[2]
        cl[a] += cl.pop(b)


@pytest.mark.parametrize("local", [0, 40, 200_000])
def test_linkage_against_greedy(spark, monkeypatch, local):
    """Without ties, merging reciprocal nearest neighbours gives what greedy merging gives, in tasks and in rounds of jobs."""
    monkeypatch.setattr(linkage, "LOCAL_EDGES", local)
    for seed in (1, 2):
        r = random.Random(seed)
        sim = {(a, b): round(r.uniform(0.3, 1), 6) for a in range(24) for b in range(a + 1, 24) if a % 4 == b % 4 or r.random() < 0.15}
        nodes = spark.createDataFrame([(i, 1) for i in range(24)], "node bigint, w int")
        edges = spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "a bigint, b bigint, sim double")
        out = {}
        for x in linkage.cluster(nodes, edges, 0.4).collect():
            out.setdefault(x.cluster, set()).add(x.node)
        assert {frozenset(v) for v in out.values()} == _average_linkage(range(24), sim, 0.4)


@pytest.mark.parametrize("local", [0, 200_000])
def test_ties_merge_together(spark, monkeypatch, local):
    monkeypatch.setattr(linkage, "LOCAL_EDGES", local)
    nodes = spark.createDataFrame([(i, 1) for i in range(32)], "node bigint, w int")
    edges = spark.createDataFrame([(a, b, 0.8) for a in range(32) for b in range(a + 1, 32)], "a bigint, b bigint, sim double")
    assert {x.cluster for x in linkage.cluster(nodes, edges, 0.4).collect()} == {0}
    assert linkage.cluster(nodes, edges.limit(0), 0.4).count() == 32


def test_both_ways_break_ties_alike(spark, monkeypatch):
    """A chain, a ring and a grid of equal similarities, and one of few different ones: tasks and rounds of jobs give the same clusters."""
    r = random.Random(8)
    pairs = {(i, i + 1): 0.8 for i in range(40)} | {(100 + i, 100 + (i + 1) % 17): 0.5 for i in range(16)}
    pairs |= {(200 + 6 * y + x, 200 + 6 * (y + dy) + x + dx): 0.75 for y in range(6) for x in range(6) for dx, dy in ((0, 1), (1, 0)) if x + dx < 6 and y + dy < 6}
    pairs |= {(a, b): r.choice([0.4, 0.6, 1 / 3, 0.9]) for a in range(300, 330) for b in range(a + 1, 330) if r.random() < 0.4}
    edges = spark.createDataFrame([(min(p), max(p), v) for p, v in pairs.items()], "a bigint, b bigint, sim double")
    nodes = spark.createDataFrame([(i, 1 + i % 3) for i in sorted({x for p in pairs for x in p})], "node bigint, w int")
    got = []
    for local in (0, 200_000):
        monkeypatch.setattr(linkage, "LOCAL_EDGES", local)
        got.append({x.node: x.cluster for x in linkage.cluster(nodes, edges, 0.3).collect()})
    assert got[0] == got[1] and len(set(got[0].values())) > 8


def test_tie_hash_is_sparks(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rows = [(-5, 7), (0, 0), (1 << 60, -(1 << 61)), (123456789, 987654321)]
    want = [x.h for x in spark.createDataFrame(rows, "a bigint, b bigint").select(F.xxhash64("a", "b").alias("h")).collect()]
    with np.errstate(over="ignore"):
        assert linkage._tie(*(np.array(c) for c in zip(*rows))).tolist() == want


def test_column_groups(spark):
    r = random.Random(5)
    cells = []
    for g in range(4):
        core = set(range(g * 100, g * 100 + 20))
        for k in range(5):
            own = core - set(r.sample(sorted(core), 2)) | {g * 100 + 50 + k}
            cells += [(g * 10 + k, x, 1.0) for x in own]
    cells += [(90, x, 1.0) for x in range(500, 510)] + [(1, 3, 0.0), (None, 3, 1.0), (2, None, 1.0), (2, 3, None)] + [(41, x, 2.0) for x in set(c[1] for c in cells if c[0] == 0)]
    df = spark.createDataFrame(cells + cells[:50], "col_id bigint, row_id bigint, val double")
    ids = [g * 10 + k for g in range(4) for k in range(5)] + [41, 90, 99]
    dom = spark.createDataFrame([(i,) for i in ids], "id bigint")
    of, _, _ = linkage.group_of(df, dom)
    got = {}
    for x in of.collect():
        got.setdefault(x.group_id, set()).add(x.col_id)
    want = {frozenset({0, 1, 2, 3, 4, 41}), *(frozenset(range(g * 10, g * 10 + 5)) for g in range(1, 4))}
    assert {frozenset(v) for v in got.values()} == want
    assert linkage.group_pairs(of).count() == 15 + 3 * 10
    desc = linkage.describe_groups(df, dom).collect()
    assert {(x.group_id, x.size) for x in desc} == {(0, 6), (10, 5), (20, 5), (30, 5), (90, 1), (99, 1)}
    assert all(sum(y.group_id == x.group_id for y in desc) == min(3, x.size) for x in desc)
    first = next(x for x in desc if x.group_id == 0 and x.rank == 1)
    assert first.col_id in (0, 41)
    assert linkage.describe_groups(df.limit(0), dom).count() == len(ids)
