import random

import pytest

from gridloom.functions import edge
from gridloom.plans import blocks, program, transform
from gridloom.sources import dump, labels, native, rejects, streams, tables


def _lines(spark, *text):
    return spark.createDataFrame([(i, t) for i, t in enumerate(text)], "line_no bigint, value string")


def test_label_lines(spark):
    src = _lines(spark, "# note", "cat hat 0.2", "hat\tbig bat\t0.3", "bat cat", "bat cat nan", "a b x", "", None, "cat hat 0.9")
    got = {tuple(r) for r in streams.read_abc(src.select("value")).collect()}
    assert got == {("cat", "hat", 0.2), ("hat", "big bat", 0.3), ("bat", "cat", 1.0), ("cat", "hat", 0.9)}
    m = streams.load(streams.read_abc(src.select("value")), mirror=True)
    pairs = {(r.x, r.y): r.val for r in dump.pairs(m.matrix, m.col_tab, m.row_tab).collect()}
    assert pairs[("cat", "hat")] == pairs[("hat", "cat")] == 0.9
    assert len(pairs) == 6


@pytest.mark.parametrize("mode", ["extend", "restrict", "strict"])
def test_adjacency_round_trip_with_tabs(spark, mode):
    r = random.Random(4)
    names = [chr(97 + i) for i in range(10)]
    rows = {x: sorted(r.sample(names, r.randint(1, 5))) for x in names[:6]}
    src = _lines(spark, *[" ".join([x, *ys]) for x, ys in rows.items()])
    tab = spark.createDataFrame([(i, n) for i, n in enumerate(names[:7])], "id bigint, label string")
    want = {(x, y) for x, ys in rows.items() for y in ys}
    if mode == "restrict":
        want = {(x, y) for x, y in want if x in names[:7] and y in names[:7]}
    if mode == "strict":
        if any(y not in names[:7] for _, y in want):
            with pytest.raises(ValueError):
                streams.load(streams.read_etc(src), tab=tab, mode=mode)
        return
    m = streams.load(streams.read_etc(src), tab=tab, mode=mode)
    assert {(p.x, p.y) for p in dump.pairs(m.matrix, m.col_tab, m.row_tab).collect()} == want


def test_numbered_and_automatic_lines(spark):
    assert {tuple(r) for r in streams.read_123(_lines(spark, "0 3 1.5", "2 7", "-1 2", "x y", "4 9999").select("value"), max_row=100).collect()} == {(0, 3, 1.5), (2, 7, 1.0)}
    auto = streams.read_etc(_lines(spark, "5 6", "# no", "7"), numeric=True, auto_column=True)
    assert {tuple(r) for r in auto.collect()} == {(0, 5, 1.0), (0, 6, 1.0), (1, 7, 1.0)}


def test_repeats_and_symmetry(spark):
    arcs = spark.createDataFrame([(0, 1, 2.0), (0, 1, 5.0), (1, 0, 3.0), (1, 2, 4.0)], "x bigint, y bigint, val double")
    val = lambda **k: {(r.col_id, r.row_id): r.val for r in streams.load(arcs, **k).matrix.cells.collect()}
    assert val(repeats="add")[(0, 1)] == 7
    assert val(symmetric="max") == {(0, 1): 5, (1, 0): 5, (1, 2): 4, (2, 1): 4}
    assert val(symmetric="mul") == {(0, 1): 15, (1, 0): 15, (1, 2): 4, (2, 1): 4}
    assert val(ops=[edge.gq(4)]) == {(0, 1): 5, (1, 2): 4}


def test_raw_vectors(spark):
    raw = streams.read_raw(_lines(spark, "0 1:2 1:3 2 $", "0 1:9 $", "2 0:4 $"))
    m = streams.assemble(raw, repeats="add", vectors="max", image="max")
    assert {(r.col_id, r.row_id): r.val for r in m.cells.collect()} == {(0, 1): 9, (1, 0): 9, (0, 2): 4, (2, 0): 4}


def test_interchange_round_trip(spark, graph, as_dict, tmp_path):
    m = graph({(11, 22): 1, (22, 11): 0.5, (22, 2147483647): 3}, [11, 22, 33, 2147483647])
    native.write_interchange(m, f"file://{tmp_path}/x")
    parts = sorted(p for p in (tmp_path / "x").iterdir() if p.name.startswith("part"))
    whole = tmp_path / "m.mci"
    whole.write_text("".join(p.read_text() for p in parts))
    back = native.read_interchange(spark, f"file://{whole}")
    assert as_dict(back) == as_dict(m)
    assert {r.id for r in back.cols.collect()} == {11, 22, 33, 2147483647}


def test_interchange_with_canonical_domains(spark, as_dict, tmp_path):
    f = tmp_path / "t.mci"
    f.write_text("# text\n(mclheader\nmcltype matrix\ndimensions 3x2\n)\n(mclmatrix\nbegin\n0   1 2:0.5 $\n1  0 $\n)\n")
    m = native.read_interchange(spark, f"file://{f}")
    assert as_dict(m) == {(0, 1): 1, (0, 2): 0.5, (1, 0): 1}
    assert (m.cols.count(), m.rows.count()) == (2, 3)
    g = tmp_path / "nil.mci"
    g.write_text("(mclheader\nmcltype matrix\ndimensions 0x9\n)\n(mclmatrix\nbegin\n)\n")
    n = native.read_interchange(spark, f"file://{g}")
    assert as_dict(n) == {} and n.cols.count() == 9 and n.rows.count() == 0


def test_native_blocks(spark, graph, as_dict, tmp_path):
    m = graph({(c, r): c + r + 1 for c in range(6) for r in range(6)}, range(6))
    native.write(m, f"file://{tmp_path}/n")
    sub = native.read(spark, f"file://{tmp_path}/n", cols=[1, 2], rows=[0])
    assert as_dict(sub) == {(1, 0): 2, (2, 0): 3}
    assert as_dict(native.read(spark, f"file://{tmp_path}/n", skeleton=True)) == {}
    assert len(as_dict(native.read_extended(spark, f"file://{tmp_path}/n", [0], [0]))) == 11


def test_dumps(graph, spark):
    m = graph({(0, 1): 1, (0, 2): 2, (2, 0): 3}, range(3))
    tab = spark.createDataFrame([(0, "a"), (1, "b")], "id bigint, label string")
    assert {r.id: r.line for r in dump.lines(m, tab, tab).collect()} == {0: "a\tb\t?", 1: "b", 2: "?\ta"}
    assert [tuple(r) for r in dump.table(m, [1, 2]).orderBy("id").collect()] == [(0, 1.0, 2.0), (1, 0.0, 0.0), (2, 0.0, 0.0)]
    assert dump.pairs(m, half="upper").count() == 1


def test_numeric_table_and_alignments(spark):
    cells, tab = tables.read_numeric(_lines(spark, "id\ta\tb", "x\t1\tNA", "y\t\t-2.5"), skip_rows=1, skip_cols=1, label_col=0)
    assert {(r.item, r.attr): (r.val, r.is_na) for r in cells.collect()} == {(0, 0): (1, False), (0, 1): (0, True), (1, 0): (0, True), (1, 1): (-2.5, False)}
    assert {tuple(r) for r in tab.collect()} == {(0, "x"), (1, "y")}
    row = lambda e, b: "\t".join(["q", "s", "90", "50", "1", "0", "1", "50", "1", "50", e, b])
    a = tables.read_alignments(_lines(spark, row("1e-30", "100"), row("0", "200"), row("0.5", "9"), "# x").select("value"), "e", 1.0)
    assert sorted(r.val for r in a.collect()) == pytest.approx([30, 200])


def test_label_tables(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "a"), (None, "z")], "id bigint, label string")
    assert {tuple(r) for r in labels.clean(t).collect()} == {(1, "a"), (3, "a")}
    assert {tuple(r) for r in labels.duplicated(labels.clean(t)).collect()} == {("a", 2, 1)}
    u = spark.createDataFrame([(1, "b"), (2, "a")], "id bigint, label string")
    assert {r.label for r in labels.combine([t, u], "meet").collect()} == {"a"}
    assert {r.label for r in labels.combine([t, u], "left").collect()} == {"z"}


def test_transform_language(graph, as_dict):
    m = graph({(0, 1): 1, (1, 0): 4, (1, 2): 9, (2, 2): 3}, range(3))
    assert as_dict(transform.run(m, "gq(3), #max(), pow(0.5)")) == pytest.approx({(0, 1): 2, (1, 0): 2, (1, 2): 3, (2, 1): 3, (2, 2): 3**0.5})
    assert as_dict(transform.run(m, "#selfrm(),#tp()")) == {(1, 0): 1, (0, 1): 4, (2, 1): 9}
    for bad in ("gq(1", "nope(3)", "#knn()", "gq(1) lt(2)"):
        with pytest.raises(ValueError):
            transform.run(m, bad)


def test_block_language(graph, as_dict, spark):
    m = graph({(a, b): 1.0 for a in range(6) for b in range(6) if abs(a - b) == 1}, range(6))
    assert set(as_dict(blocks.run(m, "dom(cr, i(0-2))"))) == {(0, 1), (1, 0), (1, 2), (2, 1)}
    assert set(as_dict(blocks.run(m, "dom(c, I(1-5)), fin(tp)"))) == {(1, 0)}
    assert {r.id for r in blocks.run(m, "dom(cr, i(0)), ext(disc(2))").cols.collect()} == {0, 1, 2}
    assert {r.id for r in blocks.run(m, "path(1,4)").cols.collect()} == {1, 2, 3, 4}
    assert {r.id for r in blocks.run(m, "dom(cr, i(0)), ext(ring(3))").cols.collect()} == {3}
    with pytest.raises(ValueError):
        blocks.run(m, "dom(cr, i(0)")


def test_stack_programs(graph, spark, as_dict):
    m = graph({(0, 1): 2, (1, 0): 2}, range(2))
    assert program.run(spark, "2 3 add 4 mul") == [20]
    assert program.run(spark, "1 5 { 2 mul } repeat") == [32]
    assert program.run(spark, "0 { dup 5 lt } { 1 add } while") == [5]
    assert program.run(spark, "1 { /yes } { /no } ifelse 7 2 mod 3.0 2 div") == ["yes", 1, 1.5]
    assert program.run(spark, "1 2 3 3 1 roll exch pop") == [3, 2]
    assert program.run(spark, "4 /x def .x .x mul") == [16]
    assert as_dict(program.run(spark, ".m dup mul", {"m": m})[-1]) == {(0, 0): 4, (1, 1): 4}
    assert as_dict(program.run(spark, "2 id 3 mul")[-1]) == {(0, 0): 3, (1, 1): 3}
    assert program.run(spark, ".m size exch cdim", {"m": m}) == [2, 2]
    assert as_dict(program.run(spark, ".m tp add", {"m": m})[-1]) == {(0, 1): 4, (1, 0): 4}
    assert program.run(spark, "5 /y d /y u /y grep p") == [5]
    for bad in ("add", "{ 1", "}", "frobnicate", "1 0 div"):
        with pytest.raises(program.ProgramError):
            program.run(spark, bad)


def test_label_line_rejects(spark):
    good = ["1\tabc", '2\t"q ""x"" y"', '"3"\tz', '4\t"a\tb"', "5\tlast\r"]
    bad = {'6\t"open': "quoting", "7": "columns", "8\ta\tb": "columns", '9\tab"c': "quoting", '"10"\t"x" y': "quoting", "\t": None, "# c": None, "  ": None, "x\ty": "value", "12345678901\ty": "value", "2147483648\ty": "value", "11\t": "value", "12\t   ": "value", "13\ta\x07": "value", "14\ta�": "value", "99\tok": "domain", '"15\tq': "quoting", "16\ta\nb": "value", "١٢\ta": "value", '17\t""': "value"}
    text = [*good, *bad, None]
    random.Random(1).shuffle(text)
    lines = spark.createDataFrame([(i, t, "x") for i, t in enumerate(text)], "line_no bigint, raw_line string, reason string")
    dom = spark.createDataFrame([(i, "n") for i in range(1, 30)], "id bigint, label string")
    got = {text[r.line_no]: r.reason for r in rejects.load_label_lines(lines, dom).collect()}
    assert got == {**{g: None for g in good}, **{b: r for b, r in bad.items() if r}}
    rows = {r.id: r.label for r in rejects.good_rows(rejects.load_label_lines(lines, dom)).collect()}
    assert rows == {1: "abc", 2: 'q "x" y', 3: "z", 4: "a\tb", 5: "last"}
    none = rejects.load_label_lines(lines, dom.limit(0))
    assert rejects.good_rows(none).count() == 0
    assert rejects.load_label_lines(lines.limit(0), dom).count() == 0


def test_many_open_quotes_do_not_hide_lines(spark):
    text = [f'{i}\t"open {i}' if i % 3 == 0 else f"{i}\tok {i}" for i in range(1, 400)] + ['500\t"' + "x" * 100_000 + '"']
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "line_no bigint, raw_line string")
    dom = spark.range(1000)
    loaded = rejects.load_label_lines(lines, dom)
    assert rejects.failed_rows(loaded).count() == 133
    assert {r.reason for r in rejects.failed_rows(loaded).collect()} == {"quoting"}
    assert rejects.good_rows(loaded).count() == 267
