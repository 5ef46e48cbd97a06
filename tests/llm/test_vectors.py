import numpy as np
import pytest

from gridloom.llm import vectortree


def _frame(spark, items):
    return spark.createDataFrame([(i, v, 0, "c") for i, v in items], "item bigint, vals array<double>, q int, c string")


def _clustered(n=900, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    x = np.repeat(base, 3, axis=0) + rng.normal(size=(n // 3 * 3, dim)) * 0.15
    return x * rng.uniform(1e-3, 1e3, size=(len(x), 1))


def _truth(x, k, least):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= least}


def test_near_pairs_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(vectortree, "LEAF", 32)
    x = _clustered()
    near, report = vectortree.most_similar(_frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), k=5, least=0.9, recall=0.99)
    assert report["leaves"] > 8 and report["visits"] < report["leaves"]
    got, want = {(r.item, r.other) for r in near.collect()}, _truth(x, 5, 0.9)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_calibration_widens_for_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vectortree, "LEAF", 32)
    x = np.random.default_rng(4).normal(size=(800, 24))
    near, report = vectortree.most_similar(_frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), k=10, every=10, recall=0.95)
    got, want = {(r.item, r.other) for r in near.collect()}, {p for p in _truth(x, 10, -2) if p[0] % 10 == 0}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("queries", [100, 400])
def test_rare_close_pairs(spark, monkeypatch, queries):
    """Hardly a calibration query has a close neighbour: too few queries open all leaves, more are calibrated on their nearest vectors."""
    monkeypatch.setattr(vectortree, "LEAF", 8)
    monkeypatch.setattr(vectortree, "CALIBRATE", queries)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 24))
    x[1960:] = x[:40] + rng.normal(size=(40, 24)) * 0.42
    near, report = vectortree.most_similar(_frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), k=10, least=0.9, recall=0.995)
    got, want = {(r.item, r.other) for r in near.collect()}, _truth(x, 10, 0.9)
    assert report["leaves"] > 100 and 20 < len(want) < 100
    assert got <= want and len(got) >= 0.97 * len(want)
    assert report["known"] < 200 and (report["recall"] is None or report["recall"] == 1)


def test_copies_ties_and_dirty_vectors(spark):
    a = [1.0, 0.0, 0.0]
    items = [(i, a) for i in range(20)] + [(30, [5.0, 0.0, None]), (31, [0.0, 0.0, 0.0]), (32, None), (33, [0.0, float("nan"), 2.0]), (None, a), (34, []), (0, a), (35, [1e300, 1e299, 0.0])]
    near, _ = vectortree.most_similar(_frame(spark, items), k=3)
    by = {}
    for r in near.orderBy("item", "rank").collect():
        by.setdefault(r.item, []).append(r.other)
    assert by[0] == [1, 2, 3] and by[2] == [0, 1, 3] and by[30] == [0, 1, 2]
    assert 31 not in by and 32 not in by and 34 not in by
    assert by[33][0] in range(20) or by[33]
    assert 35 in by
    assert all(len(v) == 3 and i not in v for i, v in by.items())


@pytest.mark.parametrize("items", [[], [(1, [1.0, 2.0])]])
def test_too_few(spark, items):
    near, _ = vectortree.most_similar(_frame(spark, items), k=3)
    assert near.count() == 0


def test_tree_opens_leaves_in_order_of_the_worst_step():
    t = vectortree.Tree([np.eye(2, dtype=np.float32), np.array([[1, 0], [0.6, 0.8], [0, 1]], dtype=np.float32)], [np.zeros(2, int), np.array([0, 0, 1])])
    p = t.priority(np.array([[0.8, 0.6]], dtype=np.float32))
    assert p[0] == pytest.approx([0.8, 0.8, 0.6])


def test_walk_opens_the_best_leaves_first():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = vectortree.fit_tree(x, 60)
    q, pr = x[:50], t.priority(x[:50])
    got = t.walk(q, 7)
    assert np.allclose(np.take_along_axis(pr, got, 1), -np.sort(-pr, axis=1)[:, :7], atol=1e-5)
    every = t.walk(q[:3], t.leaves + 2)
    assert [sorted(r) for r in every.tolist()] == [[-1, -1, *range(t.leaves)]] * 3


def test_crowded_leaves_are_cut(spark, monkeypatch):
    """Blocks of vectors and parts of queries of a leaf give what the whole leaf gives."""
    monkeypatch.setattr(vectortree, "LEAF", 150)
    x = _clustered(450)
    df = _frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    whole = {tuple(r) for r in vectortree.most_similar(df, k=5, recall=0.99)[0].select("item", "other", "rank").collect()}
    monkeypatch.setattr(vectortree, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vectortree, "PART_ROWS", 60)
    assert {tuple(r) for r in vectortree.most_similar(df, k=5, recall=0.99)[0].select("item", "other", "rank").collect()} == whole


def test_shorter_lists_end_in_zeros(spark):
    near, _ = vectortree.most_similar(_frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0, 0.0, None]), (3, [0.0, 0.0, 0.0, 1.0])]), k=1, least=0.9)
    assert {(r.item, r.other) for r in near.collect()} == {(1, 2), (2, 1)}


def test_few_leaves_lead_to_near_pairs(spark, monkeypatch):
    """The search opens a few of many leaves, below upper nodes of any similarity; a cell holds several leaves."""
    monkeypatch.setattr(vectortree, "LEAF", 8)
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(1500, 32)), 2, axis=0) + rng.normal(size=(3000, 32)) * 0.12
    near, report = vectortree.most_similar(_frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), k=5, least=0.9, recall=0.99)
    got, want = {(r.item, r.other) for r in near.collect()}, _truth(x, 5, 0.9)
    assert report["leaves"] > 250 and report["visits"] * report.get("trees", 1) <= 8
    assert got <= want and len(got) >= 0.99 * len(want) > 2900


def test_walk_by_gaps_starts_at_the_nearest_centres():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = vectortree.fit_tree(x, 200)
    got, pr = t.walk(x[:50], 9, gaps=True), t.priority(x[:50], gaps=True)
    assert np.allclose(np.take_along_axis(pr, got, 1), -np.sort(-pr, axis=1)[:, :9], atol=1e-5)
    for q, leaf in zip(x[:50], got[:, 0]):
        node, rows = 0, np.arange(len(t.levels[0]))
        for d in range(len(t.levels)):
            node = rows[(t.levels[d][rows] @ q).argmax()]
            rows = np.flatnonzero(t.parent[d + 1] == node) if d + 1 < len(t.levels) else rows
        assert node == leaf
