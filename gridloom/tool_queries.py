"""Queries of the stack language, the file formats and the smaller tools, with their SQL beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import edge
from gridloom.matrix import Matrix, range_domain
from gridloom.operators import aggregates, clusters, dags, graphs, hierarchy, randomize, reshape, setops
from gridloom.oracle import BRAND, MATCH, PLACES, SIZE, parts
from gridloom.plans import program
from gridloom.plans.materialize import materialize, shared_folder
from gridloom.queries import _places, _t, by_brand, by_size, match_graph, part_graph, records
from gridloom.sources import labels, native, streams

SQL: dict[str, str] = {}


def _tagged(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """(op, ...) of several results of the same columns, doubles rounded."""
    out = None
    for op, df in results:
        one = df.select(F.lit(op).alias("op"), *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        out = one if out is None else out.unionByName(one)
    return out


def _cells(m: Matrix) -> DataFrame:
    return m.cells.select("col_id", "row_id", "val")


def _union(with_: str, results: dict[str, str], columns: str = "col_id, row_id, round(val, 6) AS val") -> str:
    return f"WITH {with_} " + " UNION ALL ".join(f"SELECT '{op}' AS op, {columns} FROM ({q})" for op, q in results.items())


# ---- the stack language

#: Programs over .m, the directed matches, whose value is the top of the stack.
SCALARS = {
    "size": (".m size exch pop", "n"), "dim": (".m dim exch pop", "d"), "cdim": (".m cdim", "d"), "rdim": (".m rdim", "d"), "mod": (".m size exch pop 7 mod", "n % 7"), "div": (".m size exch pop 3 div", "n // 3"), "pow": (".m cdim 2 pow", "d * d"),
    "min": (".m cdim 10 min", "least(d, 10)"), "max": (".m cdim .m size exch pop max", "greatest(d, n)"), "add": (".m cdim .m size exch pop add", "d + n"), "mul": (".m cdim 3 mul", "d * 3"), "addto": ("5 .m cdim addto pop", "5 + d"), "eq": (".m cdim .m rdim eq", "1"), "lq": (".m size exch pop .m cdim lq", "CAST(n <= d AS INT)"),
    "lt": (".m size exch pop .m cdim lt", "CAST(n < d AS INT)"), "gq": (".m size exch pop .m cdim gq", "CAST(n >= d AS INT)"), "gt": (".m cdim .m cdim gt", "0"), "ifelse": (".m cdim 300 gt { .m cdim } { 300 } ifelse", "greatest(d, 300)"), "while": (".m cdim /n def 1 { dup .n lt } { 2 mul } while", "pow(2, ceil(log2(d)))"),
    "repeat": (".m cdim 5 { 2 add } repeat", "d + 10"), "do": (".m cdim { 2 mul } do", "2 * d"), "copy": (".m cdim copy add", "2 * d"), "dup": (".m cdim dup mul", "d * d"), "mdup": ("1 .m cdim 2 mdup pop add add", "d + 2"), "exch": (".m cdim 100000 exch div", "100000 // d"), "roll": ("1 2 .m cdim 3 1 roll pop pop", "d"),
    "pop": (".m cdim 3 pop", "d"), "clear": ("9 8 clear .m cdim", "d"), "def": (".m cdim /k def .k .k add", "2 * d"), "unlink": (".m cdim /k def /k unlink", "d"), "free": (".m cdim 7 free", "d"), "quit": (".m cdim quit 5", "d"), "dgt": (".m cdim 3 dgt", "d"), "tell": (".m cdim 1 tell", "d"), "new": ("3 4 new cdim", "3"),
    "id": (".m cdim id size exch pop", "d"), "jj": ("3 4 jj size exch pop", "12"), "set": ("5 5 new 1 2 7 set size exch pop", "1"), "user": ("{ 2 mul } /twice def .m cdim .twice do", "2 * d"),
}
TEXTS = {"list": ("1 .m list", "int Matrix"), "vars": (".m cdim /k def vars", "k m"), "grep": ("/roll grep", "roll"), "ops": ("/mdup grep", "mdup")}


def stack_scalars(spark: SparkSession, d: str) -> DataFrame:
    """(op, value): what programs of numbers, names, blocks and stack effects leave."""
    a = match_graph(spark, d, True)
    m = Matrix(materialize(a.cells), materialize(a.cols), a.cols)
    m = Matrix(m.cells, m.cols, m.cols)
    rows = [(k, str(int(program.run(spark, p, {"m": m})[-1]))) for k, (p, _) in SCALARS.items()]
    rows += [(k, str(program.run(spark, p, {"m": m})[-1])) for k, (p, _) in TEXTS.items()]
    return spark.createDataFrame(rows, "op string, value string")


SQL["stack_scalars"] = f"WITH {MATCH}, k AS (SELECT (SELECT count(*) FROM arcs) AS n, (SELECT count(*) FROM dom) AS d) " + " UNION ALL ".join(
    [f"SELECT '{op}' AS op, CAST(CAST({q} AS BIGINT) AS VARCHAR) AS value FROM k" for op, (_, q) in SCALARS.items()] + [f"SELECT '{op}', '{q}'" for op, (_, q) in TEXTS.items()]
)

#: Programs over .m (directed matches), .g (both ways) and .k (brands of the parts) whose value is a matrix.
MATRICES = {
    "addtp": (".m addtp", "SELECT col_id, row_id, sum(val) AS val FROM (SELECT * FROM arcs UNION ALL SELECT row_id, col_id, val FROM arcs) GROUP BY ALL"),
    "min": (".m .g min", "SELECT a.col_id, a.row_id, least(a.val, g.val) AS val FROM arcs a JOIN g ON a.col_id = g.col_id AND a.row_id = g.row_id"),
    "max": (".m .g max", "SELECT * FROM g"), "hdm": (".m .g hdm", "SELECT a.col_id, a.row_id, a.val * g.val AS val FROM arcs a JOIN g ON a.col_id = g.col_id AND a.row_id = g.row_id"),
    "hdp": (".m 2 hdp", "SELECT col_id, row_id, val * val AS val FROM arcs"), "ch": (".m ch", "SELECT col_id, row_id, 1.0 AS val FROM arcs"), "div": (".m 4 div", "SELECT col_id, row_id, val / 4 AS val FROM arcs"), "mul": (".m .g mul", "SELECT b.col_id, a.row_id, sum(a.val * b.val) AS val FROM g b JOIN arcs a ON a.col_id = b.row_id GROUP BY ALL"),
    "tp": (".m tp", "SELECT row_id AS col_id, col_id AS row_id, val FROM arcs"), "xpn": (".m xpn", "SELECT b.col_id, a.row_id, sum(a.val * b.val) AS val FROM arcs b JOIN arcs a ON a.col_id = b.row_id GROUP BY ALL"),
    "pow": (".m 2 pow", "SELECT b.col_id, a.row_id, sum(a.val * b.val) AS val FROM arcs b JOIN arcs a ON a.col_id = b.row_id GROUP BY ALL"),
    "st": (".m st", "SELECT col_id, row_id, val / sum(val) OVER (PARTITION BY col_id) AS val FROM arcs"), "infl": (".m 2 infl", "SELECT col_id, row_id, val * val / sum(val * val) OVER (PARTITION BY col_id) AS val FROM arcs"),
    "block": (".p .k block", "SELECT q.* FROM q JOIN brand x ON x.node = q.col_id JOIN brand y ON y.node = q.row_id WHERE x.cluster = y.cluster"), "outside": (".p .k block pop", "SELECT q.* FROM q JOIN brand x ON x.node = q.col_id JOIN brand y ON y.node = q.row_id WHERE x.cluster <> y.cluster"),
    "user": ("{ 2 hdp ch } /f def .m .f do", "SELECT col_id, row_id, 1.0 AS val FROM arcs"),
}


def stack_matrices(spark: SparkSession, d: str) -> DataFrame:
    """(op, col_id, row_id, val): what programs of matrices leave."""
    k = by_brand(spark, d).select(F.col("cluster").alias("col_id"), F.col("node").alias("row_id"), F.lit(1.0).alias("val"))
    names = {"m": match_graph(spark, d, True), "g": match_graph(spark, d), "k": Matrix.of(k), "p": part_graph(spark, d)}
    return _tagged([(op, _cells(program.run(spark, p, dict(names))[-1])) for op, (p, _) in MATRICES.items()])


SQL["stack_matrices"] = _union(f"{MATCH}, {parts('q')}, {BRAND}", {op: q for op, (_, q) in MATRICES.items()})


def stack_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(node, n): the systems that the best arc of every record leads to, by the operator that interprets a matrix."""
    m = match_graph(spark, d)
    loops = Matrix(setops.identity(m.cols).cells, m.cols, m.rows)
    return program.run(spark, ".i imac", {"i": loops})[-1].cells.groupBy(F.col("row_id").alias("node")).agg(F.count("*").alias("n"))


SQL["stack_clusters"] = f"WITH {MATCH} SELECT id AS node, CAST(1 AS BIGINT) AS n FROM dom"


def stack_files(spark: SparkSession, d: str) -> DataFrame:
    """Cells written by a program, loaded by another that is itself read from a file."""
    base = f"{shared_folder(spark)}/gridloom/{uuid.uuid4().hex}"
    spark.createDataFrame([(f"/{base}/m lm",), ("2 hdp",)], "line string").coalesce(1).write.text(f"{base}/program")
    program.run(spark, f".m vm /{base}/m wm", {"m": match_graph(spark, d, True)})
    return _tagged([("loaded", _cells(program.run(spark, f"/{base}/program lf")[-1]))])


SQL["stack_files"] = _union(MATCH, {"loaded": "SELECT col_id, row_id, val * val AS val FROM arcs"})


# ---- files


def native_files(spark: SparkSession, d: str) -> DataFrame:
    """A matrix written natively and read whole, by columns and rows, extended, and as domains only."""
    path = f"{shared_folder(spark)}/gridloom/{uuid.uuid4().hex}"
    native.write(match_graph(spark, d, True), path)
    some, few = list(range(0, 400)), list(range(100, 900))
    bare = native.read(spark, path, skeleton=True)
    dims = bare.cols.agg(F.lit(-1).cast("bigint").alias("col_id"), F.count("*").alias("row_id"), F.lit(0.0).alias("val"))
    return _tagged([("whole", _cells(native.read(spark, path))), ("block", _cells(native.read(spark, path, some, few))), ("extended", _cells(native.read_extended(spark, path, some, few))), ("skeleton", bare.cells.select("col_id", "row_id", "val").unionByName(dims))])


SQL["native_files"] = _union(
    MATCH,
    {
        "whole": "SELECT * FROM arcs", "block": "SELECT * FROM arcs WHERE col_id < 400 AND row_id BETWEEN 100 AND 899", "extended": "SELECT * FROM arcs WHERE col_id < 400 OR row_id BETWEEN 100 AND 899",
        "skeleton": "SELECT CAST(-1 AS BIGINT) AS col_id, count(*) AS row_id, 0.0 AS val FROM dom",
    },
)


def interchange_text(spark: SparkSession, d: str) -> DataFrame:
    """The records' matches as an interchange file, a row a column of the matrix."""
    return native.interchange_lines(match_graph(spark, d), 4).where("part = 5").select("id", "line")


SQL["interchange_text"] = f"WITH {MATCH} SELECT col_id AS id, col_id || '  ' || string_agg(row_id || CASE WHEN round(val, 4) = 1 THEN '' ELSE ':' || CAST(round(val, 4) AS VARCHAR) END, ' ' ORDER BY row_id) || ' $' AS line FROM g GROUP BY col_id"


def interchange_read(spark: SparkSession, d: str) -> DataFrame:
    """The interchange file read back, and its dimensions."""
    path = f"{shared_folder(spark)}/gridloom/{uuid.uuid4().hex}"
    native.interchange_lines(match_graph(spark, d), 6).coalesce(1).sortWithinPartitions("part", "id").select("line").write.text(path)
    m = native.read_interchange(spark, path)
    return _tagged([("cells", _cells(m)), ("dims", m.cols.agg(F.count("*").alias("col_id")).join(m.rows.agg(F.count("*").alias("row_id"))).select("col_id", "row_id", F.lit(0.0).alias("val")))])


SQL["interchange_read"] = _union(MATCH, {"cells": "SELECT * FROM g", "dims": "SELECT count(*) AS col_id, count(*) AS row_id, 0.0 AS val FROM dom"})


def raw_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as headerless vectors, a line an order: part against its suppliers, repeats within a line by sum, repeated columns by largest."""
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))))).alias("t"))
    lines = li.select(F.struct("l_orderkey", "l_partkey").alias("k"), F.concat_ws(" ", F.col("l_partkey").cast("string"), "t", F.lit("$")).alias("value"))
    lines = lines.select((F.col("k.l_orderkey") * 100000 + F.col("k.l_partkey")).alias("line_no"), "value")
    return _tagged([("arcs", _cells(streams.assemble(streams.read_raw(lines), "add", "max", None)))])


SQL["raw_vectors"] = "WITH v AS (SELECT l_orderkey, l_partkey AS col_id, l_suppkey AS row_id, sum(CAST(CAST(l_quantity AS INT) AS DOUBLE)) AS val FROM lineitem GROUP BY ALL) SELECT 'arcs' AS op, col_id, row_id, max(val) AS val FROM v WHERE val <> 0 GROUP BY ALL"


def label_modes(spark: SparkSession, d: str) -> DataFrame:
    """(mode, n_labels, n_cells, total): matches loaded onto the labels of the left ends of strong matches, unknown labels added or ignored."""
    t = _t(spark, d, "tree_pairs").where("x IS NOT NULL AND y IS NOT NULL AND val IS NOT NULL AND NOT isnan(val)").select("x", "y", "val")
    tab = materialize(streams.label_ids(t.where("val >= 0.5").select(F.col("x").alias("label"))))
    out = None
    for mode in ("extend", "restrict"):
        got = streams.load(t, tab=tab, mode=mode)
        one = got.matrix.cells.agg(F.lit(mode).alias("mode"), F.count("*").alias("n_cells"), F.round(F.sum("val"), 4).alias("total")).join(got.matrix.cols.agg(F.count("*").alias("n_labels")))
        out = one if out is None else out.unionByName(one)
    return out.select("mode", "n_labels", "n_cells", "total")


SQL["label_modes"] = """WITH t AS (SELECT x, y, max(val) AS val FROM tree_pairs WHERE x IS NOT NULL AND y IS NOT NULL AND val IS NOT NULL AND NOT isnan(val) GROUP BY ALL HAVING max(val) <> 0), k AS (SELECT DISTINCT x AS label FROM tree_pairs WHERE y IS NOT NULL AND val >= 0.5 AND NOT isnan(val) AND x IS NOT NULL)
  SELECT 'extend' AS mode, (SELECT count(*) FROM (SELECT x FROM t UNION SELECT y FROM t)) AS n_labels, count(*) AS n_cells, round(sum(val), 4) AS total FROM t
  UNION ALL SELECT 'restrict', (SELECT count(*) FROM k), count(*), round(sum(val), 4) FROM t WHERE x IN (SELECT label FROM k) AND y IN (SELECT label FROM k)"""


def repeats(spark: SparkSession, d: str) -> DataFrame:
    """Part by supplier, order lines of the same pair merged in six ways; the first and the last follow order and line."""
    li = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("col_id"), F.col("l_suppkey").alias("row_id"), F.col("l_linenumber").cast("double").alias("val"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return _tagged([(how, setops.dedupe(li, how, "at")) for how in ("max", "min", "add", "mul", "first", "last")])


SQL["repeats"] = "WITH " + "l AS (SELECT l_partkey AS col_id, l_suppkey AS row_id, CAST(l_linenumber AS DOUBLE) AS val, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{k}' AS op, col_id, row_id, round({q}, 6) AS val FROM l GROUP BY col_id, row_id" for k, q in {"max": "max(val)", "min": "min(val)", "add": "sum(val)", "mul": "product(val)", "first": "arg_min(val, pos)", "last": "arg_max(val, pos)"}.items()
)


# ---- domains and matrices


def domain_tools(spark: SparkSession, d: str) -> DataFrame:
    """(op, id, val): domains joined, cut, numbered from 0 and laid out, vectors over them."""
    dom, tab = _t(spark, d, "coldom").select("id"), labels.clean(_t(spark, d, "tab"))
    one = lambda df: df.select("id", F.lit(1.0).alias("val"))
    vec = tab.select("id", F.length("label").cast("double").alias("val"))
    m = match_graph(spark, d)
    return _tagged(
        [
            ("merge", one(setops.union_domain(dom, tab))), ("minus", one(setops.domain_minus(dom, tab))), ("meet", one(setops.domain_meet(dom, tab))), ("canonical", reshape.canonical_map(dom).select("old", F.col("new").cast("double").alias("val")).withColumnRenamed("old", "id")),
            ("range", one(range_domain(spark, 50, 7))), ("embed", setops.embed(vec, dom, -1.0)), ("selected", one(labels.select(tab, dom).select("id"))), ("disc", one(graphs.disc(m, spark.range(3), 2))), ("column", graphs.neighbours(m, 0).select(F.col("node").alias("id"), "val")), ("by_size", one(aggregates.select_columns(m, 3, 6))),
            ("counted", one(m.cols.join(aggregates.select_columns(m, 1).withColumnRenamed("id", "_s"), F.col("id") == F.col("_s"), "left_anti"))),
        ]
    )


SQL["domain_tools"] = _union(
    MATCH + ", t AS (SELECT id, min(label) AS label FROM tab WHERE id IS NOT NULL AND label IS NOT NULL GROUP BY id)",
    {
        "merge": "SELECT id, 1.0 AS val FROM (SELECT id FROM coldom UNION SELECT id FROM t)", "minus": "SELECT id, 1.0 AS val FROM coldom WHERE id NOT IN (SELECT id FROM t)", "meet": "SELECT id, 1.0 AS val FROM coldom WHERE id IN (SELECT id FROM t)", "canonical": "SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS DOUBLE) AS val FROM coldom",
        "range": "SELECT CAST(range AS BIGINT) AS id, 1.0 AS val FROM range(7, 57)", "embed": "SELECT c.id, coalesce(CAST(length(label) AS DOUBLE), -1) AS val FROM coldom c LEFT JOIN t USING (id)", "selected": "SELECT id, 1.0 AS val FROM t WHERE id IN (SELECT id FROM coldom)",
        "disc": "SELECT DISTINCT id, 1.0 AS val FROM (SELECT id FROM dom WHERE id < 3 UNION SELECT row_id FROM g WHERE col_id < 3 UNION SELECT y.row_id FROM g x JOIN g y ON y.col_id = x.row_id WHERE x.col_id < 3)", "column": "SELECT row_id AS id, val FROM g WHERE col_id = 0",
        "by_size": "SELECT col_id AS id, 1.0 AS val FROM g GROUP BY col_id HAVING count(*) BETWEEN 3 AND 6", "counted": "SELECT id, 1.0 AS val FROM dom WHERE id NOT IN (SELECT col_id FROM g)",
    },
    "id, round(val, 6) AS val",
)


def matrix_tools(spark: SparkSession, d: str) -> DataFrame:
    """(op, col_id, row_id, val): blocks, diagonals, products of domains, cells put in and taken out, columns merged and appended."""
    m, a = match_graph(spark, d), match_graph(spark, d, True)
    low = m.cols.where("id < 500")
    vec = m.cells.groupBy(F.col("col_id").alias("id")).agg(F.sum("val").alias("val"))
    nation, region = (_t(spark, d, x).select(F.col(f"{x[0]}_{x}key").cast("bigint").alias("id")) for x in ("nation", "region"))
    first = m.cells.agg(F.min(F.struct("col_id", "row_id")).alias("k")).select("k.*").first()
    own = m.cells.where("col_id = 0").select(F.col("row_id").alias("id"), "val")
    seg = m.cells.where("col_id < 3").select(F.col("col_id").alias("vector"), F.col("row_id").alias("id"), "val")
    return _tagged(
        [
            ("reduce", _cells(reshape.reduce(m, low, low))), ("change_domains", _cells(reshape.change_domains(m, low))), ("accommodate", _cells(reshape.accommodate(m, nation, nation))), ("identity", _cells(setops.identity(m.cols))), ("constant", _cells(setops.identity(m.cols, 3.0))), ("diagonal", _cells(setops.diagonal(vec))),
            ("cartesian", _cells(setops.all_cells(nation, region, 2.0))), ("insert", _cells(reshape.upsert(a, 1, 1, 5.0))), ("replace", _cells(reshape.upsert(m, first.col_id, first.row_id, 9.0))), ("remove", _cells(reshape.remove_cell(m, first.col_id, first.row_id))), ("hdp", _cells(aggregates.hadamard_power(m, 3.0))),
            ("diag_values", aggregates.diagonal_values(reshape.set_loops(m, "max")).select(F.col("id").alias("col_id"), F.col("id").alias("row_id"), "val")), ("merge_column", _cells(setops.merge_into_column(m, own, 1, "add"))), ("append", _cells(reshape.append_columns(m, seg))), ("copy", _cells(edge.unary(m, edge.mul(1.0)))),
            ("update_diff", _cells(setops.update_where(m, a, lambda l, r: l * 2, meet=False))), ("ils", _cells(graphs.adamic_adar(m))), ("tug", _cells(graphs.tug(m, 1e6))), ("upper", _cells(reshape.upper(m))), ("lower", _cells(reshape.lower(m))),
        ]
    )


SQL["matrix_tools"] = _union(
    MATCH + ", q AS (SELECT col_id AS c, sum(val * val) AS q FROM g GROUP BY col_id), fi AS (SELECT col_id, row_id FROM g ORDER BY ALL LIMIT 1), top AS (SELECT max(id) AS t FROM dom), dg AS (SELECT col_id AS n, count(*) AS d FROM g GROUP BY col_id), "
    "half AS (SELECT e.col_id, e.row_id, sum(ln(2) / ln(d)) AS val FROM g e JOIN g x ON x.col_id = e.col_id JOIN g y ON y.col_id = e.row_id AND y.row_id = x.row_id JOIN dg ON n = x.row_id WHERE e.col_id < e.row_id GROUP BY ALL), both_ AS (SELECT * FROM half UNION ALL SELECT * FROM g WHERE col_id > row_id)",
    {
        "reduce": "SELECT * FROM g WHERE col_id < 500 AND row_id < 500", "change_domains": "SELECT * FROM g WHERE col_id < 500", "accommodate": "SELECT * FROM g", "identity": "SELECT id AS col_id, id AS row_id, 1.0 AS val FROM dom", "constant": "SELECT id AS col_id, id AS row_id, 3.0 AS val FROM dom",
        "diagonal": "SELECT col_id, col_id AS row_id, sum(val) AS val FROM g GROUP BY col_id", "cartesian": "SELECT CAST(n_nationkey AS BIGINT) AS col_id, CAST(r_regionkey AS BIGINT) AS row_id, 2.0 AS val FROM nation, region", "insert": "SELECT * FROM arcs UNION ALL SELECT 1, 1, 5.0",
        "replace": "SELECT g.col_id, g.row_id, CASE WHEN fi.col_id IS NOT NULL THEN 9.0 ELSE val END AS val FROM g LEFT JOIN fi ON g.col_id = fi.col_id AND g.row_id = fi.row_id", "remove": "SELECT g.* FROM g ANTI JOIN fi ON g.col_id = fi.col_id AND g.row_id = fi.row_id", "hdp": "SELECT col_id, row_id, val * val * val AS val FROM g",
        "diag_values": "SELECT id AS col_id, id AS row_id, coalesce(max(val), 1) AS val FROM dom LEFT JOIN g ON col_id = id GROUP BY id", "merge_column": "SELECT * FROM g WHERE col_id <> 1 UNION ALL SELECT 1, row_id, sum(val) FROM g WHERE col_id IN (0, 1) GROUP BY row_id",
        "append": "SELECT * FROM g UNION ALL SELECT t + dense_rank() OVER (ORDER BY col_id), row_id, val FROM g, top WHERE col_id < 3", "copy": "SELECT * FROM g", "update_diff": "SELECT g.col_id, g.row_id, CASE WHEN a.val IS NULL THEN g.val * 2 ELSE g.val END AS val FROM g LEFT JOIN arcs a ON a.col_id = g.col_id AND a.row_id = g.row_id",
        "ils": "SELECT col_id, row_id, max(val) AS val FROM (SELECT * FROM both_ UNION ALL SELECT row_id, col_id, val FROM both_) GROUP BY ALL",
        "tug": "SELECT g.col_id, g.row_id, g.val * (1 + coalesce(d / sqrt(x.q * y.q), 0) * 0.1) AS val FROM g JOIN q x ON x.c = g.col_id JOIN q y ON y.c = g.row_id LEFT JOIN (SELECT e.col_id, e.row_id, sum(a.val * b.val) AS d FROM g e JOIN g a ON a.col_id = e.col_id JOIN g b ON b.col_id = e.row_id AND b.row_id = a.row_id GROUP BY ALL) t ON t.col_id = g.col_id AND t.row_id = g.row_id",
        "upper": "SELECT * FROM g WHERE row_id > col_id", "lower": "SELECT * FROM g WHERE row_id < col_id",
    },
)


# ---- graphs, clusterings and levels


def path_tools(spark: SparkSession, d: str) -> DataFrame:
    """(op, a, b): nodes and steps of the shortest paths from the first part to the farthest one it reaches, layers; walks along the directed matches of records."""
    m, arcs = part_graph(spark, d), match_graph(spark, d, True)
    m = Matrix(materialize(m.cells), materialize(m.cols), m.cols)
    far = graphs.distances(m, spark.range(1)).orderBy(F.desc("dist"), "node").first().node
    lat = materialize(graphs.path_lattice(m, 0, far))
    two = lambda df, a, b: df.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    ends = spark.createDataFrame([(0,), (far,)], "id bigint")
    return _tagged([("lattice", two(lat, "layer", "node")), ("layers", two(graphs.layers(lat), "layer", "n")), ("steps", two(graphs.path_steps(m, 0, far), "tail", "head")), ("between", two(graphs.path_nodes(m, ends), "id", "id")), ("walk", two(dags.walk(arcs, 0), "level", "node")), ("reach", two(graphs.reachable(arcs, spark.range(3)), "src", "node"))])


SQL["path_tools"] = _union(
    f"RECURSIVE {MATCH}, {parts('q')}, " + "wa AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS dist UNION SELECT row_id, dist + 1 FROM wa JOIN q ON col_id = node WHERE dist < 6), da AS (SELECT node, min(dist) AS x FROM wa GROUP BY node), z AS (SELECT node AS far, x AS len FROM da ORDER BY x DESC, node LIMIT 1), "
    "wb AS (SELECT far AS node, 0 AS dist FROM z UNION SELECT row_id, dist + 1 FROM wb JOIN q ON col_id = node WHERE dist < 6), db AS (SELECT node, min(dist) AS y FROM wb GROUP BY node), lat AS (SELECT x AS layer, node FROM da JOIN db USING (node), z WHERE x + y = len), "
    "wd AS (SELECT id AS src, id AS node, 0 AS dist FROM dom WHERE id < 3 UNION SELECT src, row_id, dist + 1 FROM wd JOIN arcs ON col_id = node WHERE dist < 200), dd AS (SELECT src, node, min(dist) AS dist FROM wd GROUP BY ALL)",
    {
        "lattice": "SELECT layer AS a, node AS b FROM lat", "layers": "SELECT layer AS a, count(*) AS b FROM lat GROUP BY layer", "steps": "SELECT s.node AS a, t.node AS b FROM lat s JOIN q ON col_id = s.node JOIN lat t ON t.node = row_id AND t.layer = s.layer + 1",
        "between": "SELECT node AS a, node AS b FROM lat", "walk": "SELECT dist AS a, node AS b FROM dd WHERE src = 0", "reach": "SELECT src AS a, node AS b FROM dd WHERE dist > 0",
    },
    "CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b",
)


def cluster_tools(spark: SparkSession, d: str) -> DataFrame:
    """(op, a, b): sizes and defects of clusterings, clusterings cut to some nodes, clusters with their nodes' scores."""
    b, z, p = by_brand(spark, d), by_size(spark, d), _t(spark, d, "part").select(F.col("p_partkey").alias("id"))
    both = b.unionByName(z.select((F.col("cluster") + 1000).alias("cluster"), "node"))
    few = _t(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("id")).distinct()
    two = lambda df, x, y: df.select(F.col(x).cast("bigint").alias("a"), F.col(y).cast("bigint").alias("b"))
    bad = clusters.defects(both, p)
    scores = clusters.node_scores(part_graph(spark, d), b)
    return _tagged(
        [("sizes", two(clusters.sizes(b), "cluster", "size")), ("contingency", two(clusters.contingency(b, z).groupBy("a").agg(F.max("n").alias("n")), "a", "n"))]
        + [("project", two(clusters.by_smallest(clusters.project(b, few)), "cluster", "node")), ("n_meet", two(scores, "node", "n_meet")), ("n_out", two(scores, "node", "n_out"))]
        + [(f"defect_{c}", two(bad.withColumn("_k", F.lit(0)), "_k", c)) for c in bad.columns]
    )


SQL["cluster_tools"] = _union(
    f"{parts()}, {BRAND}, {SIZE}, few AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity >= 45), o AS (SELECT x.node, x.cluster = y.cluster AS inside FROM brand x LEFT JOIN g ON col_id = x.node LEFT JOIN brand y ON y.node = row_id WHERE row_id IS NOT NULL)",
    {
        "sizes": "SELECT cluster AS a, count(*) AS b FROM brand GROUP BY cluster", "contingency": "SELECT a, max(n) AS b FROM (SELECT x.cluster AS a, y.cluster AS c, count(*) AS n FROM brand x JOIN sz y USING (node) GROUP BY ALL) GROUP BY a",
        "project": "SELECT min(node) OVER (PARTITION BY cluster) AS a, node AS b FROM brand WHERE node IN (SELECT id FROM few)", "n_meet": "SELECT node AS a, (SELECT count(*) FROM o WHERE o.node = brand.node AND inside) AS b FROM brand",
        "n_out": "SELECT node AS a, (SELECT count(*) FROM o WHERE o.node = brand.node AND NOT inside) AS b FROM brand", "defect_clusters": "SELECT 0 AS a, (SELECT count(DISTINCT cluster) FROM brand) + (SELECT count(DISTINCT cluster) FROM sz) AS b", "defect_empty": "SELECT 0 AS a, 0 AS b",
        "defect_missing": "SELECT 0 AS a, 0 AS b", "defect_overlap": "SELECT 0 AS a, count(*) AS b FROM part",
    },
    "CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b",
)


def level_tools(spark: SparkSession, d: str) -> DataFrame:
    """(op, level, cluster, node): the customers' places as a stack turned over, transposed, sorted by coarseness, and what it is (1 or 0)."""
    h = materialize(_places(spark, d))
    yes = lambda b: spark.createDataFrame([(0, int(b), 0)], "level int, cluster bigint, node bigint")
    pick = lambda x: x.select(F.col("level").cast("int").alias("level"), F.col("cluster").cast("bigint").alias("cluster"), F.col("node").cast("bigint").alias("node"))
    return _tagged(
        [("reverse", pick(hierarchy.reverse(h))), ("transpose", pick(hierarchy.transpose_all(h))), ("coarse_first", pick(hierarchy.sort_levels(h))), ("coarse_last", pick(hierarchy.sort_levels(h, False))), ("one_level", pick(hierarchy.level(h, 1).withColumn("level", F.lit(1)))), ("nested", yes(hierarchy.is_nested(h))), ("turned_nested", yes(hierarchy.is_nested(hierarchy.reverse(h)))), ("one_domain", yes(hierarchy.has_one_domain(h)))]
    )


SQL["level_tools"] = _union(
    PLACES,
    {
        "reverse": "SELECT 2 - level AS level, cluster, node FROM h", "transpose": "SELECT level, node AS cluster, cluster AS node FROM h", "coarse_first": "SELECT 2 - level AS level, cluster, node FROM h", "coarse_last": "SELECT * FROM h", "one_level": "SELECT * FROM h WHERE level = 1",
        "nested": "SELECT 0 AS level, 1 AS cluster, 0 AS node", "turned_nested": "SELECT 0 AS level, 0 AS cluster, 0 AS node", "one_domain": "SELECT 0 AS level, 1 AS cluster, 0 AS node",
    },
    "CAST(level AS INT) AS level, CAST(cluster AS BIGINT) AS cluster, CAST(node AS BIGINT) AS node",
)


def random_graphs(spark: SparkSession, d: str) -> DataFrame:
    """(op, n): edges of graphs changed at random, counted against the original: none foreign after removal, none old or repeated among the added, weights that noise changed, a new graph's edges."""
    g = match_graph(spark, d)
    ids = reshape.canonical_map(g.cols)
    m = reshape.map_ids(Matrix(materialize(g.cells), materialize(g.cols), g.cols), ids, ids)
    m = Matrix(materialize(m.cells), materialize(m.cols), m.cols)
    old = randomize.edges(m).select("x", "y", F.lit(1).alias("o"), F.col("val").alias("ov"))

    def against(x: Matrix) -> DataFrame:
        return randomize.edges(x).join(old, ["x", "y"], "left")

    one = lambda df, c: df.agg(c.cast("bigint").alias("n"))
    less, more, other, swapped = (Matrix(materialize(x.cells), x.cols, x.rows) for x in (randomize.remove_edges(m, 50), randomize.add_edges(m, 70), randomize.noise(m, 0.1), randomize.swap_edges(m, 3)))
    new = randomize.generate(spark, 300, 900)
    return _tagged(
        [("left", one(against(less), F.count("*"))), ("left_foreign", one(against(less), F.count_if(F.col("o").isNull()))), ("more", one(against(more), F.count("*"))), ("more_kept", one(against(more), F.count_if(F.col("o").isNotNull()))), ("noisy", one(against(other), F.count_if(F.col("o").isNotNull()))), ("noisy_same", one(against(other), F.count_if(F.col("val") == F.col("ov"))))]
        + [("swapped", one(against(swapped), F.count("*"))), ("swapped_distinct", one(against(swapped), F.countDistinct("x", "y"))), ("swapped_most_moved", one(against(swapped), (F.count_if(F.col("o").isNull()) > 0.5 * F.count("*")).cast("int"))), ("new", one(randomize.edges(new), F.countDistinct("x", "y"))), ("new_outside", one(randomize.edges(new), F.count_if((F.col("x") < 0) | (F.col("y") > 299))))]
    )


SQL["random_graphs"] = _union(
    MATCH + ", k AS (SELECT count(*) AS n FROM g WHERE col_id < row_id)",
    {
        "left": "SELECT n - 50 AS n FROM k", "left_foreign": "SELECT 0 AS n", "more": "SELECT n + 70 AS n FROM k", "more_kept": "SELECT n FROM k", "noisy": "SELECT n FROM k", "noisy_same": "SELECT 0 AS n", "swapped": "SELECT n FROM k", "swapped_distinct": "SELECT n FROM k", "swapped_most_moved": "SELECT 1 AS n",
        "new": "SELECT 900 AS n", "new_outside": "SELECT 0 AS n",
    },
    "CAST(n AS BIGINT) AS n",
)


def queries() -> dict:
    return {k: globals()[k] for k in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
