import random

import pytest

from gridloom.operators import chunking


def _table(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*r, "x", 1, 7) for r in rows], "col_id bigint, row_id bigint, val double, pos string, chunk int, rank bigint")
    return spark.createDataFrame(rows, "col_id bigint, row_id bigint, val double")


def _dirty(seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(3000):
        c = 1 if r.random() < 0.4 else r.randrange(200)
        rows.append((r.choice([c, c, c, None]) if r.random() < 0.02 else c, None if r.random() < 0.01 else r.randrange(600), None if r.random() < 0.02 else float("nan") if r.random() < 0.01 else round(r.uniform(-1, 5), 1)))
    return rows + rows[:200]


@pytest.mark.parametrize("extra", [False, True])
def test_crowded_top_rows_against_plain_python(spark, extra):
    rows = _dirty()
    n, count, best = len(rows), {}, {}
    for c, r, v in rows:
        if c is not None:
            count[c] = count.get(c, 0) + 1
        if None not in (c, r, v) and v == v:
            best.setdefault(c, {})[r] = max(v, best.get(c, {}).get(r, v))
    want = {(c, r) for c, k in count.items() if k * 80 >= n for r, _ in sorted(best[c].items(), key=lambda x: (-x[1], x[0]))[:10]}
    got = chunking.crowded_top_rows(_table(spark, rows, extra), chunk_rows=16, buckets=4)
    assert {(r.col_id, r.row_id) for r in got.collect()} == want


def test_numbers_are_gapless_and_chunks_equal(spark):
    rows = [(c, r, 1.0) for c, n in ((1, 1000), (2, 37), (3, 1)) for r in range(n)]
    df = _table(spark, rows)
    for bounds in (None, chunking.range_bounds(df, "row_id", 8)):
        out = chunking.number_rows(df, "col_id", "row_id", 50, 8, bounds).collect()
        by = {}
        for r in out:
            by.setdefault(r.col_id, []).append((r.pos, r.chunk, r.row_id))
        for c, x in by.items():
            assert sorted(p for p, _, _ in x) == list(range(1, len(x) + 1))
            assert all(k == (p - 1) // 50 for p, k, _ in x)
            if bounds is not None:
                assert [r for _, _, r in sorted(x)] == list(range(len(x)))


def test_column_profile_against_plain_python(spark):
    rows = _dirty(3)
    cols = {}
    for c, r, v in rows:
        if None not in (c, r, v) and v == v:
            d = cols.setdefault(c, {})
            d[r] = max(v, d.get(r, v))
    got = {r.col_id: tuple(r)[1:] for r in chunking.column_profile(_table(spark, rows), 7, 5).collect()}
    for c, d in cols.items():
        ids = sorted(d)
        gap = max([b - a for a, b in zip(ids, ids[1:])], default=0)
        assert got[c] == (len(ids), max(d.values()), ids[0], ids[-1], gap, ids[(len(ids) + 1) // 2 - 1])
    assert got.keys() == cols.keys()


def test_empty_table(spark):
    e = _table(spark, [])
    assert chunking.crowded_top_rows(e).count() == 0
    assert chunking.column_profile(e).count() == 0
