import random
from fractions import Fraction

import pytest

from gridloom.llm import setjoin

CELLS = "item bigint, attr bigint, val double, is_na boolean"


def _rows(spark, sets, extra=False):
    rows = [(i, a, 1.0, False) for i, s in sets.items() for a in s]
    random.Random(1).shuffle(rows)
    if extra:
        return spark.createDataFrame([(*r, 5, "b", 1) for r in rows], CELLS + ", id bigint, tok string, n int")
    return spark.createDataFrame(rows, CELLS)


def _truth(sets, t):
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def _found(spark, df, t):
    pairs, members, _ = setjoin.set_join(setjoin.item_sets(df), t)
    got = [(r.a, r.b) for r in setjoin.expand_pairs(pairs, members).collect()]
    assert len(got) == len(set(got))
    return set(got)


def _random_sets(seed, n=160, vocabulary=60):
    r = random.Random(seed)
    sets = {}
    for i in range(n):
        if i and r.random() < 0.5:
            s = set(sets[r.randrange(i)])
            for _ in range(r.randint(0, 3)):
                s.add(int(r.paretovariate(0.7)) % vocabulary) if r.random() < 0.5 else s.discard(next(iter(s), None))
        else:
            s = {int(r.paretovariate(0.7)) % vocabulary for _ in range(r.randint(1, 25))}
        sets[i] = s
    return sets


@pytest.mark.parametrize("t", [Fraction(3, 5), Fraction(2, 5), Fraction(9, 10)])
@pytest.mark.parametrize("common", [0, 3, 48])
def test_join_against_all_pairs(spark, monkeypatch, t, common):
    """With a low bar every key is extended as far as it goes."""
    monkeypatch.setattr(setjoin, "COMMON", common)
    sets = _random_sets(5)
    assert _found(spark, _rows(spark, sets, extra=common == 3), t) == _truth(sets, t)


def test_crowded_keys_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "SLICE", 3)
    sets = _random_sets(6)
    assert _found(spark, _rows(spark, sets), Fraction(1, 2)) == _truth(sets, Fraction(1, 2))
    monkeypatch.setattr(setjoin, "CROWDED", 0)
    assert _found(spark, _rows(spark, sets), Fraction(1, 2)) == _truth(sets, Fraction(1, 2))


def test_keys_do_not_lengthen_with_the_table(spark):
    """Records with the same few tokens beside ever more others: keys hold as many records as before."""

    def most(others):
        family = [(i, tok) for i in range(200) for tok in (*range(6), 1000 + i, 2000 + i)]
        rest = [(10_000 + i, 100_000 + 3 * i + j) for i in range(others) for j in range(3)]
        sets, giants = setjoin.token_sets(spark.createDataFrame(family + rest, "id bigint, tok bigint"))
        assert giants.isEmpty()
        return setjoin.keyed(sets, Fraction(3, 5), sets.count()).groupBy("k").count().agg({"count": "max"}).first()[0]

    assert most(20_000) <= most(20)


def test_small_sets_on_common_tokens(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "COMMON", 0)
    sets = dict(enumerate([{1}, {1, 2}, {1, 2, 3}, {1, 2, 3, 4}, {1, 3}, {2}, {2, 3}, {1, 2, 4}, {1, 2, 3, 4, 5}, {4, 5}]))
    for t in (Fraction(1, 2), Fraction(2, 3), Fraction(2, 5)):
        assert _found(spark, _rows(spark, sets), t) == _truth(sets, t)


def test_sets_too_large_for_one_row(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "GIANT", 40)
    r = random.Random(3)
    base = set(range(100))
    sets = {0: base, 1: set(base), 2: set(r.sample(sorted(base), 70)), 3: set(r.sample(sorted(base), 41)), 4: set(r.sample(sorted(base), 39)), 5: base | set(range(100, 150)), 6: set(range(38)), 7: set(range(30))}
    assert _found(spark, _rows(spark, sets), Fraction(3, 5)) == _truth(sets, Fraction(3, 5))
    assert (0, 1) in _truth(sets, Fraction(3, 5))


def test_large_copies_beside_giants(spark, monkeypatch):
    """Copies just below the bound meet giants once, by their representative; identical giants are a class too."""
    monkeypatch.setattr(setjoin, "GIANT", 40)
    small, giant = set(range(39)), set(range(50))
    sets = {0: small, 1: giant, 2: set(small), 3: set(giant), 4: set(small), 5: set(giant), 6: set(range(100, 150)), 7: giant | {50}}
    df, t = _rows(spark, sets), Fraction(3, 5)
    assert _found(spark, df, t) == _truth(sets, t)
    pairs, members, _ = setjoin.set_join(setjoin.item_sets(df), t)
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 1), (0, 7), (1, 7)}
    links = {r.id: (r.class_id, r.n_links) for r in setjoin.record_links(pairs, members, setjoin.item_sets(df).select("id").distinct()).collect()}
    assert links == {0: (0, 6), 2: (0, 6), 4: (0, 6), 1: (1, 6), 3: (1, 6), 5: (1, 6), 6: (6, 0), 7: (7, 6)}


def test_large_copies_beside_a_giant_are_grouped_once(spark, monkeypatch):
    from gridloom.llm import linkage

    monkeypatch.setattr(setjoin, "GIANT", 40)
    sets = {0: set(range(39)), 1: set(range(50)), 2: set(range(39)), 3: set(range(50)), 4: set(range(100, 139))}
    cells = spark.createDataFrame([(c, r, 1.0) for c, s in sets.items() for r in s], "col_id bigint, row_id bigint, val double")
    groups, _, _ = linkage.group_of(cells, spark.createDataFrame([(i,) for i in sets], "id bigint"))
    assert sorted((r.col_id, r.group_id) for r in groups.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_copies_are_classes(spark):
    sets = {i: {1, 2, 3} for i in range(60)} | {100: {1, 2, 3, 4}, 101: {9}}
    df = _rows(spark, sets)
    pairs, members, _ = setjoin.set_join(setjoin.item_sets(df), Fraction(3, 5))
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 100)]
    assert members.count() == 60
    ids = setjoin.item_sets(df).select("id").distinct()
    links = {r.id: (r.class_id, r.n_links) for r in setjoin.record_links(pairs, members, ids).collect()}
    assert links[7] == (0, 60) and links[100] == (100, 60) and links[101] == (101, 0)


def test_dirty_rows_and_empty_table(spark):
    rows = [(1, 1, 1.0, False), (1, 1, 2.0, False), (1, 2, 1.0, False), (1, 3, 0.0, False), (1, 4, None, False), (1, 5, float("nan"), False), (1, 6, 1.0, True), (1, 7, 1.0, None), (None, 1, 1.0, False), (2, None, 1.0, False), (2, 1, 1.0, False), (2, 2, 1.0, False), (3, 9, 0.0, False)]
    df = spark.createDataFrame(rows, CELLS)
    assert _found(spark, df, Fraction(3, 5)) == {(1, 2)}
    assert _found(spark, df.limit(0), Fraction(3, 5)) == set()
