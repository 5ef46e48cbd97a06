import random

import pytest

from gridloom.functions.merge import MERGES
from gridloom.operators import setops


def _random(seed, n=8, k=30):
    r = random.Random(seed)
    return {(r.randrange(n), r.randrange(n)): round(r.uniform(0.5, 4), 2) for _ in range(k)}


@pytest.mark.parametrize("seed", [1, 2])
def test_difference_and_meet_divide_the_left_side(graph, as_dict, seed):
    a, b = graph(_random(seed), range(8)), graph(_random(seed + 10), range(8))
    diff, meet = as_dict(setops.restrict_columns(a, b, keep=False)), as_dict(setops.restrict_columns(a, b, keep=True))
    assert diff.keys().isdisjoint(meet)
    assert diff | meet == as_dict(a)
    assert as_dict(setops.binary(a, b, "or")) == as_dict(b) | as_dict(a)


def test_merges_against_plain_python(graph, as_dict):
    a, b = _random(3), _random(4)
    keys = a.keys() | b.keys()
    plain = {"add": lambda l, r: l + r, "sub": lambda l, r: l - r, "mul": lambda l, r: l * r, "min": min, "max": max, "cross": lambda l, r: l * r if l and r else l + r, "arcmax": lambda l, r: l if not (l and r) or l >= r else 0}
    for name, f in plain.items():
        want = {k: f(a.get(k, 0), b.get(k, 0)) for k in keys}
        got = as_dict(setops.binary(graph(a, range(8)), graph(b, range(8)), name))
        assert got == pytest.approx({k: v for k, v in want.items() if v}), name
    assert len(MERGES) == 19


def test_product_and_powers(graph, as_dict):
    a = _random(5)
    m = graph(a, range(8))

    def mul(x, y):
        out = {}
        for (c, k), v in y.items():
            for (k2, r), w in x.items():
                if k == k2:
                    out[c, r] = out.get((c, r), 0) + v * w
        return out

    assert as_dict(setops.compose(m, m)) == pytest.approx(mul(a, a))
    assert as_dict(setops.matrix_power(m, 3)) == pytest.approx(mul(a, mul(a, a)))
    assert as_dict(setops.step(m, 2)) == pytest.approx(mul(mul(a, a), mul(a, a)))
    assert as_dict(setops.matrix_power(m, 0)) == {(i, i): 1.0 for i in range(8)}


def test_domains(spark):
    d = lambda *x: spark.createDataFrame([(i,) for i in x], "id bigint")
    assert setops.count_parts(d(1, 2, 3), d(3, 4)).first().asDict() == {"left_only": 2, "both": 1, "right_only": 1}
    r = setops.relate(d(1, 2, 3), d(1, 3)).first()
    assert r["super"] and not r["sub"] and not r["equal"] and not r["disjoint"]
    e = setops.relate(spark.createDataFrame([], "id bigint"), spark.createDataFrame([], "id bigint")).first()
    assert e["equal"] and e["disjoint"]


def test_arc_filters_and_transpose(graph, as_dict):
    m = graph({(0, 1): 5, (1, 0): 2, (1, 2): 1, (2, 2): 4}, range(3))
    assert as_dict(setops.arc_select(m, "max", "gq", 5)) == {(0, 1): 5, (1, 0): 2}
    assert as_dict(setops.arc_select(m, "min", "gq", 2)) == {(0, 1): 5, (1, 0): 2, (2, 2): 4}
    assert as_dict(setops.arc_select(m, "diff", "gq", 3)) == {(0, 1): 5, (1, 0): 2}
    assert as_dict(setops.add_transpose(m, 0.5)) == {(0, 1): 7, (1, 0): 7, (1, 2): 1, (2, 1): 1, (2, 2): 4}
    assert as_dict(setops.mutual(m)) == {(0, 1): 5, (1, 0): 2, (2, 2): 4}


def test_dedupe(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 0), (1, 1, 5.0, 1), (1, 1, 3.0, 2), (2, 1, 1.0, 3)], "col_id bigint, row_id bigint, val double, p int")
    got = {h: setops.dedupe(rows, h, "p").where("col_id = 1").first().val for h in ("max", "min", "add", "mul", "first", "last")}
    assert got == {"max": 5, "min": 2, "add": 10, "mul": 30, "first": 2, "last": 3}
