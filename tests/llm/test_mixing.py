import random

import pytest

from gridloom.llm import mixing


def _counted(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def _corpus(seed=1):
    r = random.Random(seed)
    return [(i, r.choices("abc", [8, 2, 1])[0], r.randint(1, 200)) for i in range(3000)]


def _by(mix):
    out = {}
    for r in mix.collect():
        out[r.source] = out.get(r.source, 0) + r.n_tokens * r.copies
    return out


def test_shares_and_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = _corpus()
    total = sum(n for *_, n in rows)
    mix = mixing.fair_mix(_counted(spark, rows), [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 9)])
    got = _by(mix)
    assert total - 200 <= sum(got.values()) <= total
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert got[s] / total == pytest.approx(w, abs=0.003)
    caps = {"a": 1, "b": 3, "c": 9}
    assert all(1 <= r.copies <= caps[r.source] for r in mix.collect())


def test_exhausted_sources_leave_their_share(spark):
    rows = [(i, "a", 10) for i in range(1000)] + [(5000 + i, "b", 10) for i in range(10)]
    got = _by(mixing.fair_mix(_counted(spark, rows), [("a", 0.5, 4), ("b", 0.5, 2), ("none", 0.0001, 1)]))
    assert got == {"a": 9900, "b": 200}
    short = _by(mixing.fair_mix(_counted(spark, rows), [("a", 0.5, 1), ("b", 0.5, 1)], budget=10**6))
    assert short == {"a": 10000, "b": 100}


def test_the_mix_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 64)
    rows = _corpus(2)
    t = [("a", 0.2, 1), ("b", 0.5, 4), ("c", 0.3, 6)]
    one = {tuple(r) for r in mixing.fair_mix(_counted(spark, rows), t).collect()}
    two = {tuple(r) for r in mixing.fair_mix(_counted(spark, rows[::-1]).repartition(7), t).collect()}
    assert one == two


def test_dirty_tables(spark):
    docs = spark.createDataFrame([(1, "one two", "a", 9), (2, None, "a", 9), (3, "", "a", 9), (4, "x", None, 9), (5, "y", "z", 9), (None, "q", "a", 9), (6, "three", "b", 9)], "doc_id bigint, text string, source string, copies int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2), (None, 0.1, 1), ("c", None, 1), ("d", 0.2, 0), ("e", 0.1, 3)], "source string, target_share double, max_repeats int")
    counted, listed = mixing.weigh(docs, targets)
    assert {r.doc_id for r in counted.collect()} == {1, 2, 3, 6}
    mix = mixing.fair_mix(counted, listed)
    s = {r.source: r for r in mixing.shares(mix, targets).collect()}
    assert s["e"].n_docs == 0 and s["e"].actual_share == 0
    assert sum(r.actual_share for r in s.values()) == pytest.approx(1)
    empty, listed = mixing.weigh(docs.limit(0), targets)
    assert mixing.fair_mix(empty, listed).count() == 0
    assert mixing.shares(mixing.fair_mix(empty, listed), targets).count() == 5
