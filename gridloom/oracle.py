"""The queries of ``queries`` as DuckDB SQL over the same tables."""

from __future__ import annotations

MAXF = "3.4028234663852886e38"

# ---- the matrices of ``queries`` as common table expressions
LP = "lp AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"
_URGENT = "SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {} o_orderpriority IN ('1-URGENT', '2-HIGH')"


def parts(name: str = "g", least: int = 1, urgent: bool | None = None) -> str:
    src = f"lp_{name}"
    rows = "SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem" if urgent is None else _URGENT.format("" if urgent else "NOT")
    return f"{src} AS ({rows}), {name} AS (SELECT a.p AS col_id, b.p AS row_id, CAST(count(*) AS DOUBLE) AS val FROM {src} a JOIN {src} b ON a.o = b.o AND a.p <> b.p GROUP BY ALL HAVING count(*) >= {least})"


RECORDS = "lab AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT x AS label FROM tree_pairs WHERE x IS NOT NULL UNION SELECT y FROM tree_pairs WHERE y IS NOT NULL)), dom AS (SELECT id FROM lab)"
ARCS = RECORDS + ", arcs AS (SELECT a.id AS col_id, b.id AS row_id, max(val) AS val FROM tree_pairs JOIN lab a ON a.label = x JOIN lab b ON b.label = y WHERE x <> y AND val IS NOT NULL AND NOT isnan(val) GROUP BY a.id, b.id)"
MATCH = ARCS + ", g AS (SELECT col_id, row_id, max(val) AS val FROM (SELECT * FROM arcs UNION ALL SELECT row_id, col_id, val FROM arcs) GROUP BY ALL)"
NODES = "dom AS (SELECT p_partkey AS id FROM part)"
TRADE = """t AS (SELECT CAST(s_nationkey AS BIGINT) AS col_id, CAST(c_nationkey AS BIGINT) AS row_id, CAST(count(*) AS DOUBLE) AS val FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
NET = TRADE + """, tk AS (SELECT *, count(*) OVER (PARTITION BY col_id ORDER BY val DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM t WHERE col_id <> row_id),
  tt AS (SELECT col_id, row_id, val FROM tk WHERE n <= 3),
  net AS (SELECT col_id, row_id, max(val) AS val FROM (SELECT * FROM tt UNION ALL SELECT row_id, col_id, val FROM tt) GROUP BY ALL)"""
BRAND = "brand AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS cluster, p_partkey AS node FROM part)"
SIZE = "sz AS (SELECT CAST(p_size AS BIGINT) AS cluster, p_partkey AS node FROM part)"
CELLS = "c AS (SELECT col_id, row_id, max(val) AS val FROM cells WHERE col_id IS NOT NULL AND row_id IS NOT NULL AND val IS NOT NULL AND val <> 0 GROUP BY ALL)"
CLEAN = "clean AS (SELECT col_id, row_id, max(val) AS val FROM cells WHERE col_id IS NOT NULL AND row_id IS NOT NULL AND val IS NOT NULL AND NOT isnan(val) GROUP BY col_id, row_id)"
EVENTS = """kinds AS (SELECT DISTINCT event_type FROM events), t AS (SELECT user_id AS item, event_type AS attr, round(sum(value), 3) AS val FROM events GROUP BY ALL HAVING round(sum(value), 3) <> 0),
  n AS (SELECT count(DISTINCT attr) AS n FROM t), s AS (SELECT item, sum(val) AS s, sum(val * val) AS q, count(*) AS k FROM t GROUP BY item)"""
SETS = "u AS (SELECT DISTINCT l_suppkey AS item, CAST(p_size AS BIGINT) AS attr FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49)"
PLACES = """pl AS (SELECT c_custkey AS node, CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
  h AS (SELECT 0 AS level, n AS cluster, node FROM pl UNION ALL SELECT 1, r, node FROM pl UNION ALL SELECT 2, 0, node FROM pl)"""
E2 = "e AS (SELECT DISTINCT a, b FROM (SELECT col_id AS a, row_id AS b FROM {0} WHERE col_id <> row_id UNION ALL SELECT row_id, col_id FROM {0} WHERE col_id <> row_id))"
R = "SELECT col_id, row_id, round(val, 6) AS val FROM {}"


def _digest(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS op, count(*) AS n, round(coalesce(sum(val), 0), 4) AS total FROM ({q})" for n, q in rows)


def _edge() -> str:
    v = {
        "gq_2": "CASE WHEN val >= 2 THEN val ELSE 0 END", "gt_1": "CASE WHEN val > 1 THEN val ELSE 0 END", "lq_1": "CASE WHEN val <= 1 THEN val ELSE 0 END", "lt_2": "CASE WHEN val < 2 THEN val ELSE 0 END", "mul_1.5": "val * 1.5", "scale_4": "val / 4",
        "add_-2": "val - 2", "abs_": "abs(val)", "ceil_1.5": "least(val, 1.5)", "floor_1.5": "greatest(val, 1.5)", "pow_0.5": "sqrt(val)", "exp_": "exp(val)", "exp_2": "pow(2, val)", "log_": "ln(val)", "log_10": "ln(val) / ln(10)", "neglog_": "-ln(val)", "const_7": "7",
    }
    return f"WITH {parts()} " + _digest([(k, f"SELECT CAST({x} AS DOUBLE) AS val FROM g WHERE CAST({x} AS DOUBLE) <> 0") for k, x in v.items()])


def _merges() -> str:
    both = "l <> 0 AND r <> 0"
    v = {
        "left": "l", "right": "r", "add": "l + r", "sub": "l - r", "mul": "l * r", "cross": f"CASE WHEN {both} THEN l * r ELSE l + r END", "min": "least(l, r)", "max": "greatest(l, r)", "minnz": f"CASE WHEN {both} THEN least(l, r) ELSE 0 END", "maxnz": f"CASE WHEN {both} THEN greatest(l, r) ELSE 0 END",
        "or": "CASE WHEN l <> 0 THEN l ELSE r END", "and_not": "CASE WHEN r = 0 THEN l ELSE 0 END", "and": "CASE WHEN r <> 0 THEN l ELSE 0 END", "arcmax": f"CASE WHEN {both} THEN CASE WHEN l >= r THEN l ELSE 0 END ELSE l END", "arcsub": "l - r", "zero": "0", "half": "0.5", "one": "1", "one_and_half": "1.5",
    }
    base = f"WITH {parts('a', 1, True)}, {parts('b', 1, False)}, j AS (SELECT coalesce(a.val, 0) AS l, coalesce(b.val, 0) AS r FROM a FULL JOIN b ON a.col_id = b.col_id AND a.row_id = b.row_id) "
    return base + " UNION ALL ".join(f"SELECT '{k}' AS op, count(*) FILTER (WHERE x <> 0) AS n, round(sum(x), 4) AS total FROM (SELECT CAST({q} AS DOUBLE) AS x FROM j)" for k, q in v.items())


def _arcs() -> str:
    cmp = {"gq": ">=", "gt": ">", "lq": "<=", "lt": "<"}
    rows = []
    for kind in ("max", "min", "diff"):
        for c, o in cmp.items():
            test = {"max": f"(l {o} 40 OR r {o} 40)", "min": f"(l {o} 40 AND r {o} 40)", "diff": f"(l - r {o} 5 OR r - l {o} 5)"}[kind]
            rows.append((f"{kind}_{c}", f"SELECT l AS val FROM j WHERE l <> 0 AND {test}"))
    return f"WITH {TRADE}, s AS (SELECT col_id, row_id, round(val / sum(val) OVER (PARTITION BY col_id) * 1000) AS val FROM t), j AS (SELECT coalesce(a.val, 0) AS l, coalesce(b.val, 0) AS r FROM s a FULL JOIN s b ON a.col_id = b.row_id AND a.row_id = b.col_id) " + _digest(rows)


def _loops() -> str:
    off = "SELECT val FROM g"
    m = lambda e: f"{off} UNION ALL SELECT {e} FROM dom LEFT JOIN (SELECT col_id, max(val) AS mx, sum(val) AS sm FROM g GROUP BY col_id) ON id = col_id WHERE {e} <> 0"
    rows = [("max", m("coalesce(nullif(mx, 0), 1)")), ("sum", m("coalesce(nullif(sm, 0), 1)")), ("one", m("1.0")), ("empty", m("CASE WHEN mx IS NULL THEN 1.0 ELSE 0.0 END")), ("remove", off)]
    return f"WITH {parts()}, {NODES} " + _digest(rows)


PREP = f"{MATCH}, w AS (SELECT * FROM g UNION ALL SELECT id, id, coalesce(mx, 1) FROM dom LEFT JOIN (SELECT col_id, max(val) AS mx FROM g GROUP BY col_id) ON id = col_id), m AS (SELECT col_id, row_id, val / sum(val) OVER (PARTITION BY col_id) AS val FROM w)"
TPREP = f"{TRADE}, toff AS (SELECT * FROM t WHERE col_id <> row_id), nd AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation), tw AS (SELECT * FROM toff UNION ALL SELECT id, id, coalesce(mx, 1) FROM nd LEFT JOIN (SELECT col_id, max(val) AS mx FROM toff GROUP BY col_id) ON id = col_id), m AS (SELECT col_id, row_id, val / sum(val) OVER (PARTITION BY col_id) AS val FROM tw)"
BFS = "RECURSIVE " + NET + ", " + E2.format("net") + ", nd AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation), walk AS (SELECT id AS src, id AS node, 0 AS dist FROM nd UNION SELECT src, b, dist + 1 FROM walk JOIN e ON node = a WHERE dist < 25), d AS (SELECT src, node, min(dist) AS dist FROM walk GROUP BY ALL)"
_PS = "x.item AS x, y.item AS y, sum(x.val * y.val) AS xy, count(*) AS c"
SCORES = (
    "g AS (SELECT col_id, row_id, val FROM gg), own AS (SELECT a.cluster, a.node, g.row_id, g.val, b.node IS NOT NULL AS inside FROM brand a LEFT JOIN gg g ON g.col_id = a.node LEFT JOIN brand b ON b.node = g.row_id AND b.cluster = a.cluster), "
    "sc AS (SELECT node, any_value(cluster) AS cluster, coalesce(sum(val) FILTER (WHERE inside), 0) AS i, coalesce(sum(val) FILTER (WHERE NOT inside), 0) AS o, count(val) FILTER (WHERE NOT inside) AS no, sum(val * val) AS q, max(val) AS mx FROM own GROUP BY node), "
    "cs AS (SELECT cluster AS k, count(*) AS size FROM brand GROUP BY cluster), "
    "ns AS (SELECT *, CASE WHEN i + o > 0 THEN 1 - (size - (i - o) / ((i + o) * (q / ((i + o) * (i + o))))) / (size + no) ELSE 0 END AS cov, CASE WHEN i + o > 0 THEN 1 - (size - (i - o) / ((i + o) * (mx / (i + o)))) / (size + no) ELSE 0 END AS covmax, CASE WHEN i + o > 0 THEN i / (i + o) ELSE 0 END AS mf FROM sc JOIN cs ON k = cluster)"
)
CONT = f"{BRAND}, {SIZE}, ct AS (SELECT brand.cluster AS a, sz.cluster AS b, count(*) AS n FROM brand JOIN sz USING (node) GROUP BY ALL), sa AS (SELECT a, sum(n) AS n, max(n) AS top FROM ct GROUP BY a), sb AS (SELECT b, sum(n) AS n, max(n) AS top FROM ct GROUP BY b)"
ODD = f"{BRAND}, {SIZE}, ov AS (SELECT cluster, node FROM brand WHERE node % 2 = 1 UNION ALL SELECT cluster + 1000, node FROM sz WHERE node % 2 = 1)"
COMPLETE = "SELECT id AS col_id, coalesce(n, 0) AS n, round(coalesce(total, 0), 6) AS total, round(coalesce(power_sum, 0), 6) AS power_sum, round(coalesce(norm, 0), 6) AS norm, round(top, 6) AS top, round(least, 6) AS least, coalesce(highest_row, -1) AS highest_row, round(coalesce(self_val, 0), 6) AS self_val, coalesce(has_loop, 0) AS has_loop"


def _label_lines(then: str) -> str:
    field = r'(?:"(?:[^"]|"")*"|[^"\t]*)'
    plain = lambda c: f"CASE WHEN {c} LIKE '\"%' THEN replace(substr({c}, 2, length({c}) - 2), '\"\"', '\"') ELSE {c} END"
    return rf"""WITH s AS (SELECT line_no, regexp_replace(raw_line, '\r$', '') AS s FROM tab_lines WHERE raw_line IS NOT NULL),
      d AS (SELECT line_no, s, regexp_full_match(s, '{field}(?:\t{field})*') AS fits, regexp_full_match(s, '{field}\t{field}') AS two FROM s WHERE NOT regexp_matches(s, '^\s*(#|$)')),
      f AS (SELECT *, CASE WHEN fits AND two THEN regexp_extract(s, '^({field})\t({field})$', 1) END AS a, CASE WHEN fits AND two THEN regexp_extract(s, '^({field})\t({field})$', 2) END AS b FROM d),
      u AS (SELECT *, {plain('a')} AS id, {plain('b')} AS label FROM f),
      judged AS (SELECT line_no, id, label, CASE WHEN NOT fits THEN 'quoting' WHEN NOT two THEN 'columns' WHEN NOT regexp_full_match(id, '[0-9]{{1,10}}') OR TRY_CAST(id AS BIGINT) > 2147483647 OR regexp_full_match(label, '\s*') OR regexp_matches(label, '[\x00-\x08\x0a-\x1f\x7f\x{{80}}-\x{{9f}}\x{{fffd}}]') THEN 'value'
        WHEN TRY_CAST(id AS BIGINT) NOT IN (SELECT id FROM coldom) THEN 'domain' END AS reason FROM u) {then}"""


def oracle_sql() -> dict[str, str]:
    g, m = f"WITH {parts()} ", f"WITH {MATCH} "
    return {
        "p3_found": f"""WITH crowded AS (SELECT col_id FROM cells WHERE col_id IS NOT NULL GROUP BY col_id HAVING count(*) * 80 >= (SELECT count(*) FROM cells)),
          {CLEAN}, r AS (SELECT col_id, row_id, row_number() OVER (PARTITION BY col_id ORDER BY val DESC, row_id) AS k FROM clean JOIN crowded USING (col_id))
          SELECT col_id, row_id FROM r WHERE k <= 10""",
        "p3_column_profile": f"""WITH {CLEAN}, g AS (SELECT *, row_id - lag(row_id) OVER (PARTITION BY col_id ORDER BY row_id) AS gap,
            row_number() OVER (PARTITION BY col_id ORDER BY row_id) AS pos, count(*) OVER (PARTITION BY col_id) AS n FROM clean)
          SELECT col_id, count(*) AS n_cells, max(val) AS max_val, min(row_id) AS first_row, max(row_id) AS last_row,
            coalesce(max(gap), 0) AS widest_gap, max(CASE WHEN pos = (n + 1) // 2 THEN row_id END) AS median_row FROM g GROUP BY col_id""",
        "p6_found": _label_lines("SELECT line_no, reason FROM judged WHERE reason IS NOT NULL"),
        "p6_good": _label_lines("SELECT line_no, CAST(id AS BIGINT) AS id, label FROM judged WHERE reason IS NULL"),
        "edge_functions": _edge(),
        "edge_chain": g + ", s AS (SELECT col_id, row_id, CASE WHEN val > 0.5 THEN ln((val - 0.5) * 3) END AS val FROM g WHERE val <> 0.5) SELECT col_id, row_id, round(greatest(val, 0.5), 6) AS val FROM s WHERE val <> 0",
        "merge_functions": _merges(),
        "arc_filters": _arcs(),
        "matrix_add": f"WITH {parts('a', 1, True)}, {parts('b', 1, False)} SELECT col_id, row_id, sum(val) AS val FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL",
        "matrix_hadamard": f"WITH {parts('a', 1, True)}, {parts('b', 1, False)} SELECT col_id, row_id, a.val * b.val AS val FROM a JOIN b USING (col_id, row_id)",
        "matrix_minus": f"WITH {parts('a', 1)}, {parts('b', 1, True)} SELECT col_id, row_id, val FROM a ANTI JOIN b USING (col_id, row_id)",
        "matrix_meet": f"WITH {parts('a', 1)}, {parts('b', 1, True)} SELECT col_id, row_id, val FROM a SEMI JOIN b USING (col_id, row_id)",
        "update_meet": f"WITH {parts('a', 1)}, {parts('b', 1, True)} SELECT a.col_id, a.row_id, CASE WHEN b.val IS NULL THEN a.val ELSE a.val * 10 + b.val END AS val FROM a LEFT JOIN b USING (col_id, row_id)",
        "inner_products": f"WITH {parts('a', 1, True)}, {parts('b', 1, False)} SELECT col_id, sum(a.val * b.val) AS val FROM a JOIN b USING (col_id, row_id) GROUP BY col_id",
        "domain_parts": "WITH k AS (SELECT DISTINCT col_id AS id FROM cells WHERE col_id IS NOT NULL) SELECT (SELECT count(*) FROM coldom ANTI JOIN k USING (id)) AS left_only, (SELECT count(*) FROM coldom SEMI JOIN k USING (id)) AS both, (SELECT count(*) FROM k ANTI JOIN coldom USING (id)) AS right_only",
        "domain_relations": "WITH a AS (SELECT DISTINCT id FROM tab WHERE id IS NOT NULL), p AS (SELECT (SELECT count(*) FROM a ANTI JOIN coldom USING (id)) AS l, (SELECT count(*) FROM a SEMI JOIN coldom USING (id)) AS m, (SELECT count(*) FROM coldom ANTI JOIN a USING (id)) AS r) SELECT l = 0 AND r = 0 AS equal, r = 0 AS super, l = 0 AS sub, m = 0 AS disjoint, m > 0 AS meet, l > 0 AND m > 0 AND r > 0 AS trisphere, l > 0 AS ldiff, r > 0 AS rdiff FROM p",
        "domain_embed": g + f", {NODES} SELECT id, coalesce(v, -1.0) AS val FROM dom LEFT JOIN (SELECT col_id, sum(val) AS v FROM g GROUP BY col_id) ON id = col_id",
        "transpose_sum": f"WITH {TRADE} SELECT col_id, row_id, sum(CASE WHEN col_id = row_id THEN val / 2 ELSE val END) AS val FROM (SELECT * FROM t UNION ALL SELECT row_id, col_id, val FROM t) GROUP BY ALL",
        "mutual_arcs": f"WITH {TRADE}, k AS (SELECT *, count(*) OVER (PARTITION BY col_id ORDER BY val DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM t), s AS (SELECT col_id, row_id, val FROM k WHERE n <= 5) SELECT s.* FROM s SEMI JOIN s r ON s.col_id = r.row_id AND s.row_id = r.col_id",
        "compose": m + "SELECT b.col_id, a.row_id, sum(a.val * b.val) AS val FROM g b JOIN g a ON a.col_id = b.row_id GROUP BY ALL",
        "compose_bipartite": f"WITH {BRAND}, {SIZE} SELECT brand.cluster AS col_id, sz.cluster AS row_id, CAST(count(*) AS DOUBLE) AS val FROM brand JOIN sz USING (node) GROUP BY ALL",
        "power_step": f"WITH {TRADE}, m AS (SELECT col_id, row_id, val / sum(val) OVER (PARTITION BY col_id) AS val FROM t), q AS (SELECT b.col_id, a.row_id, sum(a.val * b.val) AS val FROM m b JOIN m a ON a.col_id = b.row_id GROUP BY ALL), z AS (SELECT b.col_id, a.row_id, sum(a.val * b.val) AS val FROM q b JOIN q a ON a.col_id = b.row_id GROUP BY ALL) " + R.format("z"),
        "times_vector": g + "SELECT row_id AS id, round(sum(val * p_retailprice), 2) AS val FROM g JOIN part ON col_id = p_partkey GROUP BY row_id",
        "dedupe_cells": f"WITH {CELLS} " + R.format("c"),
        "dedupe_sum": "WITH k AS (SELECT col_id, row_id, sum(val) AS s, min(val) AS m FROM cells WHERE col_id IS NOT NULL AND row_id IS NOT NULL AND val IS NOT NULL AND val <> 0 GROUP BY ALL) " + _digest([("add", "SELECT s AS val FROM k WHERE s <> 0"), ("min", "SELECT m AS val FROM k")]),
        "sub_matrix": f"WITH {CELLS}, k AS (SELECT DISTINCT id FROM tab SEMI JOIN coldom USING (id) WHERE label IS NOT NULL) SELECT col_id, row_id, round(val, 6) AS val FROM c WHERE col_id IN (SELECT id FROM k) AND row_id IN (SELECT id FROM rowdom WHERE id % 3 = 0)",
        "extended_sub": g + "SELECT g.* FROM g WHERE col_id IN (SELECT p_partkey FROM part WHERE p_size >= 45) OR row_id IN (SELECT p_partkey FROM part WHERE p_size <= 3)",
        "triangles_of_matrix": f"WITH {TRADE} " + _digest([("lower", "SELECT val FROM t WHERE row_id < col_id"), ("upper", "SELECT val FROM t WHERE row_id > col_id"), ("no_loops", "SELECT val FROM t WHERE row_id <> col_id"), ("loops_half", "SELECT CASE WHEN row_id = col_id THEN val / 2 ELSE val END AS val FROM t")]),
        "value_range": f"WITH {CELLS} SELECT col_id, row_id, round(val, 6) AS val FROM c WHERE val >= 0.25 AND val < 0.75 AND row_id >= 1000",
        "loops": _loops(),
        "loops_max": f"WITH {parts()}, {NODES} SELECT * FROM g UNION ALL SELECT id, id, coalesce(mx, 1) FROM dom LEFT JOIN (SELECT col_id, max(val) AS mx FROM g GROUP BY col_id) ON id = col_id",
        "block_inside": g + f", {BRAND} SELECT col_id, row_id, val FROM g JOIN brand a ON a.node = col_id JOIN brand b ON b.node = row_id WHERE a.cluster = b.cluster",
        "block_between": g + f", {BRAND} SELECT col_id, row_id, val FROM g JOIN brand a ON a.node = col_id JOIN brand b ON b.node = row_id WHERE a.cluster <> b.cluster",
        "block_partition": f"WITH {parts('g', 1)}, {SIZE}, j AS (SELECT g.*, a.cluster = b.cluster AS same FROM g JOIN sz a ON a.node = col_id JOIN sz b ON b.node = row_id), bar AS (SELECT col_id AS c, quantile_cont(val, 0.5) AS bar FROM j WHERE NOT same GROUP BY col_id), k AS (SELECT col_id, row_id, val FROM j LEFT JOIN bar ON c = col_id WHERE same AND (bar IS NULL OR val > bar)) SELECT k.col_id, k.row_id, least(k.val, r.val) AS val FROM k JOIN k r ON k.col_id = r.row_id AND k.row_id = r.col_id",
        "unlink_nodes": m + ", ok AS (SELECT id FROM dom LEFT JOIN (SELECT col_id, count(*) AS n FROM g GROUP BY col_id) ON id = col_id WHERE coalesce(n, 0) BETWEEN 2 AND 6) SELECT * FROM g WHERE col_id IN (SELECT id FROM ok) AND row_id IN (SELECT id FROM ok)",
        "fold_nodes": g + ", rep AS (SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS r FROM part), f AS (SELECT a.r AS col_id, b.r AS row_id, max(val) AS val FROM g JOIN rep a ON a.node = col_id JOIN rep b ON b.node = row_id GROUP BY ALL) SELECT col_id, row_id, max(val) AS val FROM (SELECT * FROM f UNION ALL SELECT row_id, col_id, val FROM f) GROUP BY ALL",
        "canonical_ids": "SELECT id AS old, row_number() OVER (ORDER BY id) - 1 AS new FROM coldom",
        "map_ids": g + "SELECT col_id * 2 + 5 AS col_id, row_id - 1 AS row_id, val FROM g",
        "scrub_domains": f"WITH {CELLS} SELECT 'cols' AS domain, count(DISTINCT col_id) AS n FROM c UNION ALL SELECT 'rows', count(DISTINCT row_id) FROM c UNION ALL SELECT 'all_cols', count(*) FROM coldom UNION ALL SELECT 'all_rows', count(*) FROM rowdom",
        "column_stats": f"WITH {CELLS}, s AS (SELECT col_id, count(*) AS n, sum(val) AS total, sum(val * val) AS power_sum, sqrt(sum(val * val)) AS norm, max(val) AS top, min(val) AS least, max(row_id) AS highest_row, max(val) FILTER (WHERE col_id = row_id) AS self_val, max(CAST(col_id = row_id AS INTEGER)) AS has_loop FROM c GROUP BY col_id) {COMPLETE} FROM coldom LEFT JOIN s ON id = col_id",
        "row_sizes": f"WITH {CELLS} SELECT id AS row_id, coalesce(n, 0) AS n FROM rowdom LEFT JOIN (SELECT row_id, count(*) AS n FROM c GROUP BY row_id) ON id = row_id",
        "matrix_summary": f"WITH {CELLS} SELECT count(*) AS n_cells, round(sum(val), 2) AS mass, round(max(val), 2) AS top FROM c",
        "mean_sd": g + "SELECT col_id, round(sum(val) / (SELECT count(*) FROM part), 6) AS mean, round(sqrt(greatest(sum(val * val) / (SELECT count(*) FROM part) - pow(sum(val) / (SELECT count(*) FROM part), 2), 0)), 6) AS sd FROM g GROUP BY col_id",
        "column_median": f"WITH {CELLS} SELECT col_id, round(quantile_cont(val, 0.5), 6) AS val FROM c GROUP BY col_id",
        "stochastic": g + "SELECT col_id, row_id, round(val / sum(val) OVER (PARTITION BY col_id), 6) AS val FROM g",
        "inflate": g + "SELECT col_id, row_id, round(pow(val, 1.8) / sum(pow(val, 1.8)) OVER (PARTITION BY col_id), 6) AS val FROM g",
        "norm_self": f"WITH {TRADE} SELECT col_id, row_id, round(val / coalesce(max(CASE WHEN col_id = row_id THEN val END) OVER w, max(val) OVER w), 6) AS val FROM t WINDOW w AS (PARTITION BY col_id)",
        "z_scores": f"WITH {TRADE} SELECT col_id, row_id, round(CASE WHEN stddev_pop(val) OVER w > 0 THEN (val - avg(val) OVER w) / stddev_pop(val) OVER w ELSE val - avg(val) OVER w END, 6) AS val FROM t WINDOW w AS (PARTITION BY col_id)",
        "top_k_drop": f"WITH {CELLS}, k AS (SELECT *, count(*) OVER (PARTITION BY col_id ORDER BY val DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM c) SELECT col_id, row_id, round(val, 6) AS val FROM k WHERE n <= 5",
        "top_k_keep": g + ", k AS (SELECT *, rank() OVER (PARTITION BY col_id ORDER BY val DESC) AS n FROM g) SELECT col_id, row_id, val FROM k WHERE n <= 3",
        "top_k_above": g + ", k AS (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY val DESC) AS n FROM g), b AS (SELECT *, max(CASE WHEN n = 3 THEN val END) OVER (PARTITION BY col_id) AS bar FROM k) SELECT col_id, row_id, val FROM b WHERE bar IS NULL OR val > bar",
        "k_bar": f"WITH {CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY val DESC) AS n FROM c) SELECT col_id, round(val, 6) AS val FROM k WHERE n = 3",
        "knn": f"WITH {TRADE}, k AS (SELECT *, count(*) OVER (PARTITION BY col_id ORDER BY val DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM t), s AS (SELECT col_id, row_id, val FROM k WHERE n <= 8) SELECT s.* FROM s SEMI JOIN s r ON s.col_id = r.row_id AND s.row_id = r.col_id",
        "quantiles": f"WITH {TRADE}, k AS (SELECT *, count(*) OVER (PARTITION BY col_id ORDER BY val DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, floor(count(*) OVER (PARTITION BY col_id) * 0.3 + 0.5) AS m FROM t) SELECT col_id, row_id, val FROM k WHERE n <= m",
        "ssq_filter": f"WITH {TRADE}, k AS (SELECT *, sum(CASE WHEN col_id <> row_id THEN val ELSE 0 END) OVER w AS s, sum(CASE WHEN col_id <> row_id THEN val * val ELSE 0 END) OVER w AS q FROM t WINDOW w AS (PARTITION BY col_id)) SELECT col_id, row_id, val FROM k WHERE s <> 0 AND val > q / s",
        "average_ranks": g + "SELECT col_id, row_id, rank() OVER (PARTITION BY col_id ORDER BY val) + (count(*) OVER (PARTITION BY col_id, val) - 1) / 2.0 AS val FROM g",
        "columns_by_size": f"WITH {TRADE}, s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, coalesce(sum(val), 0) AS v FROM nation LEFT JOIN t ON col_id = n_nationkey GROUP BY n_nationkey) SELECT id AS old, row_number() OVER (ORDER BY v DESC, id) - 1 AS new FROM s",
        "collect_tables": "SELECT CAST(o_custkey AS VARCHAR) AS label, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS val_0, CAST(count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS DOUBLE) AS val_1, CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS DOUBLE) AS val_2 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY o_custkey",
        "transform_program": f"WITH {TRADE}, a AS (SELECT * FROM t WHERE val >= 2 AND col_id <> row_id), b AS (SELECT col_id, row_id, max(val) AS val FROM (SELECT * FROM a UNION ALL SELECT row_id, col_id, val FROM a) GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY col_id ORDER BY val DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM b), s AS (SELECT col_id, row_id, val FROM k WHERE n <= 9) SELECT s.col_id, s.row_id, round(sqrt(s.val) * 2, 6) AS val FROM s SEMI JOIN s r ON s.col_id = r.row_id AND s.row_id = r.col_id",
        "transform_edges": g + "SELECT col_id, row_id, round(least(ln(val + 1) / ln(2), 1.2), 6) AS val FROM g",
        "common_neighbours": m + ", q AS (SELECT col_id, sum(val * val) AS q FROM g GROUP BY col_id), dt AS (SELECT g.col_id, g.row_id, sum(a.val * b.val) AS d FROM g JOIN g a ON a.col_id = g.col_id JOIN g b ON b.col_id = g.row_id AND b.row_id = a.row_id GROUP BY ALL) SELECT dt.col_id, dt.row_id, round(d / sqrt(x.q * y.q), 6) AS val FROM dt JOIN q x ON x.col_id = dt.col_id JOIN q y ON y.col_id = dt.row_id",
        "flow_prepare": f"WITH {PREP} " + R.format("m"),
        "flow_round": f"WITH {PREP}, x AS (SELECT b.col_id, a.row_id, sum(a.val * b.val) AS val FROM m b JOIN m a ON a.col_id = b.row_id GROUP BY ALL), y AS (SELECT *, max(val) OVER w AS top, sum(val * val) OVER w AS q FROM x WINDOW w AS (PARTITION BY col_id)), k AS (SELECT *, val / sum(val) OVER (PARTITION BY col_id) AS v, count(*) OVER (PARTITION BY col_id) AS n FROM y WHERE val >= 0.02) SELECT col_id, row_id, round(v * v / sum(v * v) OVER (PARTITION BY col_id) + 1e-9, 6) AS val, round((top - q) * n + 1e-9, 6) AS chaos FROM k",
        "flow_dag": f"WITH {TPREP}, k AS (SELECT *, coalesce(max(CASE WHEN col_id = row_id THEN val END) OVER w, 0) AS s, max(val) OVER w AS mx FROM m WINDOW w AS (PARTITION BY col_id)), b AS (SELECT col_id, row_id, val / sum(val) OVER (PARTITION BY col_id) AS val, count(*) OVER (PARTITION BY col_id) AS n FROM k WHERE val >= CASE WHEN s < mx THEN 0.999 * s + 0.001 * mx ELSE s / 1.01 END) SELECT col_id, row_id, round(val, 6) AS val FROM b WHERE val >= 1.0 / (n + 1)",
        "flow_homogeneity": f"WITH {TPREP}, x AS (SELECT b.col_id, a.row_id, sum(a.val * b.val) AS val FROM m b JOIN m a ON a.col_id = b.row_id GROUP BY ALL), s AS (SELECT col_id, sum(val * val) AS s FROM m GROUP BY col_id), z AS (SELECT col_id, sum(val * val) AS p, sum(pow(val, 4)) AS r FROM x GROUP BY col_id) SELECT col_id, round(s * p * p / r, 6) AS val FROM z JOIN s USING (col_id)",
        "graph_components": f"WITH RECURSIVE {MATCH}, walk AS (SELECT id AS node, id AS lab FROM dom UNION SELECT row_id, lab FROM walk JOIN g ON col_id = node) SELECT min(lab) AS component, node FROM walk GROUP BY node",
        "eccentricity": f"WITH {BFS} SELECT src AS node, max(dist) AS ecc FROM d GROUP BY src",
        "shortest_paths": f"WITH RECURSIVE {MATCH}, walk AS (SELECT id AS src, id AS node, 0 AS dist FROM dom WHERE id < 5 UNION SELECT src, row_id, dist + 1 FROM walk JOIN g ON col_id = node WHERE dist < 200) SELECT src, node, min(dist) AS dist FROM walk GROUP BY ALL",
        "path_lattice": f"WITH {BFS} SELECT x.dist AS layer, x.node FROM d x JOIN d y ON x.node = y.node AND x.src = 0 AND y.src = 24 JOIN d z ON z.src = 0 AND z.node = 24 WHERE x.dist + y.dist = z.dist",
        "betweenness": f"WITH {BFS}, paths AS (SELECT src, node, dist, CAST(1 AS DOUBLE) AS n, dist AS lev FROM d WHERE dist = 0 UNION ALL SELECT * FROM (SELECT src, node, dist, sum(n) AS n, dist AS lev FROM (SELECT p.src, d.node, d.dist, p.n FROM paths p JOIN e ON e.a = p.node JOIN d ON d.src = p.src AND d.node = e.b AND d.dist = p.dist + 1) GROUP BY src, node, dist)), sc AS (SELECT v.node, sum(a.n * b.n / z.n) AS x FROM paths a JOIN paths z ON z.src = a.src AND z.node <> a.src JOIN d v ON v.src = z.node AND v.node = a.node JOIN paths b ON b.src = z.node AND b.node = a.node WHERE a.node <> a.src AND a.node <> z.node AND a.dist + v.dist = z.dist GROUP BY v.node) SELECT nd.id AS node, round(coalesce(x, 0), 6) AS score FROM nd LEFT JOIN sc ON sc.node = nd.id",
        "clustering_coefficient": m + ", dg AS (SELECT col_id, count(*) AS d FROM g GROUP BY col_id), tr AS (SELECT x.col_id, count(*) AS n FROM g x JOIN g y ON y.col_id = x.row_id JOIN g z ON z.col_id = x.col_id AND z.row_id = y.row_id GROUP BY x.col_id) SELECT id AS node, round(CASE WHEN coalesce(d, 0) > 1 THEN coalesce(n, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clcf FROM dom LEFT JOIN dg ON dg.col_id = id LEFT JOIN tr ON tr.col_id = id",
        "cycle_nodes": f"WITH RECURSIVE {TRADE}, k AS (SELECT *, rank() OVER (PARTITION BY col_id ORDER BY val DESC) AS n FROM t WHERE col_id <> row_id), e AS (SELECT col_id AS a, row_id AS b FROM k WHERE n <= 1), walk AS (SELECT a AS s, b AS node, 1 AS l FROM e UNION SELECT s, b, l + 1 FROM walk JOIN e ON node = a WHERE l < 26), onc AS (SELECT DISTINCT s FROM walk WHERE s = node), fw AS (SELECT DISTINCT s AS id FROM walk WHERE node IN (SELECT s FROM onc)), bw AS (SELECT DISTINCT node AS id FROM walk WHERE s IN (SELECT s FROM onc)) SELECT id FROM fw SEMI JOIN bw USING (id)",
        "node_attributes": g + f", {NODES} SELECT id AS node, coalesce(degree, 0) AS degree, round(mean, 6) AS mean, least, top, median FROM dom LEFT JOIN (SELECT col_id, count(*) AS degree, avg(val) AS mean, min(val) AS least, max(val) AS top, quantile_cont(val, 0.5) AS median FROM g GROUP BY col_id) ON id = col_id",
        "top_degree": m + "SELECT col_id AS node, count(*) AS degree FROM g GROUP BY col_id ORDER BY degree DESC, node LIMIT 25",
        "weight_histogram": f"WITH {CELLS} SELECT CAST(least(greatest(floor(val / 0.1), 0), 19) AS INTEGER) AS bin, count(*) AS n FROM c GROUP BY 1",
        "sorted_weights": f"WITH {CELLS}, k AS (SELECT val, count(*) AS n FROM c GROUP BY val) SELECT val, n, CAST(sum(n) OVER (ORDER BY val DESC) - n + 1 AS BIGINT) AS position FROM k",
        "cross_ratio": f"WITH {TRADE}, j AS (SELECT t.col_id AS x, t.row_id AS y, t.val AS arc, coalesce(r.val, 0) AS reverse, coalesce(a.val, 0) AS self_x, coalesce(b.val, 0) AS self_y FROM t LEFT JOIN t r ON r.col_id = t.row_id AND r.row_id = t.col_id LEFT JOIN t a ON a.col_id = t.col_id AND a.row_id = t.col_id LEFT JOIN t b ON b.col_id = t.row_id AND b.row_id = t.row_id) SELECT * FROM j WHERE least(self_x, self_y) > arc OR least(self_x, self_y) > reverse",
        "select_children": f"WITH {SETS}, k AS (SELECT item, count(*) AS n FROM u GROUP BY item), p AS (SELECT x.item AS x, y.item AS y, count(*) AS c FROM u x JOIN u y USING (attr) GROUP BY ALL), s AS (SELECT x, y, (n - c) / n AS v FROM p JOIN k ON item = x WHERE n > c), q AS (SELECT a.item AS a, b.item AS b, coalesce(s.v, 0) AS v, coalesce(r.v, 0) AS w FROM k a JOIN k b ON a.item < b.item LEFT JOIN s ON s.x = a.item AND s.y = b.item LEFT JOIN s r ON r.x = b.item AND r.y = a.item) SELECT CASE WHEN v < w THEN a ELSE b END AS col_id, CASE WHEN v < w THEN b ELSE a END AS row_id, round(abs(v - w), 6) AS val FROM q WHERE least(v, w) <= 0.5 AND greatest(v, w) >= 0.7 AND v <> w",
        "diagonal_order": f"WITH {TPREP} SELECT col_id AS node, round(max(CASE WHEN col_id = row_id THEN val ELSE 0 END) / sum(val * val), 6) AS val FROM m GROUP BY col_id",
        "shadow_factors": f"WITH {MATCH}, s AS (SELECT col_id AS k, count(*) AS n, sum(val) AS t FROM g GROUP BY col_id), p AS (SELECT g.col_id, any_value(a.n) AS n0, any_value(a.t) AS t0, sum(g.val / a.t * b.n) AS size, sum(g.val / a.t * CASE WHEN b.n < 2 THEN b.t / b.n ELSE (b.t - g.val) / (b.n - 1) END) AS gauge FROM g JOIN s a ON a.k = g.col_id JOIN s b ON b.k = g.row_id GROUP BY g.col_id) SELECT id, round(coalesce(pow(greatest(n0 / size, (t0 / n0) / gauge, 1), 1.5) - 1, 0), 6) AS val FROM dom LEFT JOIN p ON col_id = id",
        "nested_scores": f"WITH {parts('gg')}, {BRAND}, {SIZE}, kid AS (SELECT node, brand.cluster AS parent, min(node) OVER (PARTITION BY brand.cluster, sz.cluster) AS cluster, count(*) OVER (PARTITION BY brand.cluster, sz.cluster) AS size, count(*) OVER (PARTITION BY brand.cluster) AS psize FROM brand JOIN sz USING (node)), own AS (SELECT a.*, gg.val, b.cluster IS NOT DISTINCT FROM a.cluster AND gg.val IS NOT NULL AS inside, b.parent IS NOT DISTINCT FROM a.parent AND gg.val IS NOT NULL AS fam FROM kid a LEFT JOIN gg ON gg.col_id = a.node LEFT JOIN kid b ON b.node = gg.row_id), "
        + ", ".join(f"{n} AS (SELECT node, any_value(cluster) AS cluster, any_value(size) AS size, coalesce(sum(val) FILTER (WHERE inside), 0) AS i, coalesce(sum(val) FILTER (WHERE NOT inside{w}), 0) AS o, count(val) FILTER (WHERE NOT inside{w}) AS no, sum(val * val) FILTER (WHERE inside OR true{w}) AS q, max(val) FILTER (WHERE inside OR true{w}) AS mx FROM own GROUP BY node), {n}s AS (SELECT cluster, avg(CASE WHEN i + o > 0 THEN 1 - (size - (i - o) * (i + o) / q) / (size + no) ELSE 0 END) AS cov, avg(CASE WHEN i + o > 0 THEN 1 - (size - (i - o) / mx) / (size + no) ELSE 0 END) AS covmax, avg(CASE WHEN i + o > 0 THEN i / (i + o) ELSE 0 END) AS mf FROM {n} GROUP BY cluster)" for n, w in (("w", ""), ("f", " AND fam")))
        + ", k AS (SELECT DISTINCT cluster, parent, size, psize FROM kid) SELECT k.cluster, parent, size, round(ws.cov + 1e-9, 6) AS cov, round(ws.covmax + 1e-9, 6) AS covmax, round(ws.mf + 1e-9, 6) AS massfrac, round(CASE WHEN size = psize THEN 1 ELSE fs.cov END + 1e-9, 6) AS within_cov, round(CASE WHEN size = psize THEN 1 ELSE fs.covmax END + 1e-9, 6) AS within_covmax, round(CASE WHEN size = psize THEN 1 ELSE fs.mf END + 1e-9, 6) AS within_massfrac FROM k JOIN ws USING (cluster) JOIN fs USING (cluster)",
        "threshold_sweep": "WITH RECURSIVE "
        + MATCH
        + ", st AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS step), h AS (SELECT step, g.* FROM st JOIN g ON val >= step), walk AS (SELECT step, id AS node, id AS lab FROM st, dom UNION SELECT walk.step, h.row_id, lab FROM walk JOIN h ON h.step = walk.step AND h.col_id = node), lb AS (SELECT step, node, min(lab) AS c FROM walk GROUP BY ALL), cs AS (SELECT step, c, count(*) AS n FROM lb GROUP BY ALL), "
        "a AS (SELECT step, CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components, count(*) FILTER (WHERE n = 1) AS singletons, max(n) AS largest, round(sum(n * n) / sum(n), 6) AS spread FROM cs GROUP BY step), w AS (SELECT step, count(*) AS arcs, round(avg(val), 6) AS mean_weight, quantile_cont(val, 0.5) AS median_weight, quantile_cont(val, 0.75) - quantile_cont(val, 0.25) AS iqr_weight FROM h GROUP BY step), "
        "dg AS (SELECT st.step, dom.id, count(h.val) AS d FROM st CROSS JOIN dom LEFT JOIN h ON h.step = st.step AND h.col_id = dom.id GROUP BY ALL), ds AS (SELECT step, round(avg(d), 6) AS mean_degree, quantile_cont(d, 0.5) AS median_degree FROM dg GROUP BY step), tr AS (SELECT x.step, x.col_id, count(*) AS n FROM h x JOIN h y ON y.step = x.step AND y.col_id = x.row_id JOIN h z ON z.step = x.step AND z.col_id = x.col_id AND z.row_id = y.row_id GROUP BY ALL), "
        "cc AS (SELECT dg.step, round(avg(CASE WHEN d > 1 THEN coalesce(n, 0) / (d * (d - 1)) ELSE 0 END), 6) AS clcf FROM dg LEFT JOIN tr ON tr.step = dg.step AND tr.col_id = dg.id GROUP BY dg.step) SELECT a.*, w.* EXCLUDE (step), ds.* EXCLUDE (step), clcf FROM a JOIN w USING (step) JOIN ds USING (step) JOIN cc USING (step)",
        "pairs_pearson": f"WITH {EVENTS}, ev AS (SELECT a.item AS x, b.item AS y, a.s AS sx, b.s AS sy, a.q AS qx, b.q AS qy FROM s a, s b), p AS (SELECT x.item AS i, y.item AS j, sum(x.val * y.val) AS xy FROM t x JOIN t y ON x.attr = y.attr GROUP BY ALL), z AS (SELECT x, y, sqrt(greatest(n * qx - sx * sx, 0)) * sqrt(greatest(n * qy - sy * sy, 0)) AS den, n * coalesce(xy, 0) - sx * sy AS num FROM ev LEFT JOIN p ON i = x AND j = y, n) SELECT x, y, round(num / den, 6) AS score FROM z WHERE den <> 0 AND num <> 0 AND abs(num / den) >= 0.5",
        "pairs_spearman": EVENTS.replace("t AS (SELECT user_id AS item", "t0 AS (SELECT user_id AS item").replace("n AS (SELECT count", "t AS (SELECT item, attr, rank() OVER (PARTITION BY item ORDER BY val) + (count(*) OVER (PARTITION BY item, val) - 1) / 2.0 AS val FROM t0), n AS (SELECT count").join(["WITH ", ", ev AS (SELECT a.item AS x, b.item AS y, a.s AS sx, b.s AS sy, a.q AS qx, b.q AS qy FROM s a, s b), p AS (SELECT x.item AS i, y.item AS j, sum(x.val * y.val) AS xy FROM t x JOIN t y ON x.attr = y.attr GROUP BY ALL), z AS (SELECT x, y, sqrt(greatest(n * qx - sx * sx, 0)) * sqrt(greatest(n * qy - sy * sy, 0)) AS den, n * coalesce(xy, 0) - sx * sy AS num FROM ev LEFT JOIN p ON i = x AND j = y, n) SELECT x, y, round(num / den, 6) AS score FROM z WHERE den <> 0 AND num <> 0 AND abs(num / den) >= 0.5"]),
        "pairs_cosine": f"WITH {EVENTS}, p AS (SELECT {_PS} FROM t x JOIN t y ON x.attr = y.attr GROUP BY ALL) SELECT x, y, round(xy / sqrt(a.q * b.q), 6) AS score FROM p JOIN s a ON a.item = x JOIN s b ON b.item = y WHERE abs(xy / sqrt(a.q * b.q)) >= 0.99",
        "pairs_skew": f"WITH {EVENTS}, p AS (SELECT {_PS} FROM t x JOIN t y ON x.attr = y.attr GROUP BY ALL) SELECT x, y, round(sqrt(greatest(xy, 0)) / sqrt(a.q), 6) AS score FROM p JOIN s a ON a.item = x WHERE sqrt(greatest(xy, 0)) / sqrt(a.q) >= 1.1",
        "pairs_fingerprints": f"WITH {SETS}, k AS (SELECT item, count(*) AS n FROM u GROUP BY item), p AS (SELECT x.item AS x, y.item AS y, CAST(count(*) AS DOUBLE) AS c FROM u x JOIN u y USING (attr) GROUP BY ALL), z AS (SELECT c, a.n - c AS a, b.n - c AS b FROM p JOIN k a ON a.item = x JOIN k b ON b.item = y) "
        + " UNION ALL ".join(f"SELECT '{n}' AS kind, count(*) AS n, round(sum({q}), 3) AS total FROM z WHERE {q} <> 0" for n, q in {"tanimoto": "c / (a + b + c)", "fp_cosine": "c / sqrt((a + c) * (b + c))", "meet": "c", "cover": "c / (a + c)", "hamming": "a + b", "subset": "c / (a + c)", "subset_diff": "a / (a + c)"}.items()),
        "pairs_content": f"WITH {EVENTS}, p AS (SELECT x.item AS x, y.item AS y, sum(x.val * y.val) AS xy, sum(x.val * x.val) AS xx, sum(y.val * y.val) AS yy, count(*) AS c, quantile_cont(x.val, 0.5) AS mx, quantile_cont(y.val, 0.5) AS my FROM t x JOIN t y ON x.attr = y.attr GROUP BY ALL), z AS (SELECT x, y, least(mx, my) * xy / sqrt(xx * yy) * sqrt(xx / a.q) * c / a.k AS score, 3 * c >= a.k OR 3 * c >= b.k AS near FROM p JOIN s a ON a.item = x JOIN s b ON b.item = y) SELECT x, y, round(score, 3) AS score FROM z WHERE near AND score <> 0",
        "contingency": f"WITH {CONT} SELECT a, b, n FROM ct",
        "cluster_distances": f"WITH {CONT}, f AS (SELECT (SELECT CAST(sum(n - top) AS BIGINT) FROM sa) AS split_a, (SELECT CAST(sum(n - top) AS BIGINT) FROM sb) AS split_b, (SELECT sum(n * ln(n)) FROM sa) AS la, (SELECT sum(n * ln(n)) FROM sb) AS lb, (SELECT sum(n * ln(n)) FROM ct) AS lm, (SELECT sum(n * n) FROM sa) AS qa, (SELECT sum(n * n) FROM sb) AS qb, (SELECT sum(n * n) FROM ct) AS qm, (SELECT sum(n * (n - 1) / 2) FROM sa) AS pa, (SELECT sum(n * (n - 1) / 2) FROM sb) AS pb, (SELECT sum(n * (n - 1) / 2) FROM ct) AS pm, (SELECT count(*) FROM part) AS n) SELECT split_a, split_b, round(greatest((la - lm) / n, 0), 6) AS vi_a, round(greatest((lb - lm) / n, 0), 6) AS vi_b, CAST(qa - qm AS BIGINT) AS mirkin_a, CAST(qb - qm AS BIGINT) AS mirkin_b, round((n * (n - 1) / 2 + 2 * pm - pa - pb) / (n * (n - 1) / 2), 6) AS rand, round((pm - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS adjusted_rand, round(pm / (pa + pb - pm), 6) AS jaccard FROM f",
        "cluster_meet": f"WITH {BRAND}, {SIZE} SELECT min(node) OVER (PARTITION BY brand.cluster, sz.cluster) AS cluster, node FROM brand JOIN sz USING (node)",
        "cluster_mates": f"WITH {CONT} SELECT a, b, round(2 * ct.n / (sa.n + sb.n), 6) AS overlap, ct.n, CAST(sa.n - ct.n AS BIGINT) AS only_a, CAST(sb.n - ct.n AS BIGINT) AS only_b, CAST(sa.n AS BIGINT) AS size_a, CAST(sb.n AS BIGINT) AS size_b FROM ct JOIN sa USING (a) JOIN sb USING (b)",
        "node_volatility": "WITH p AS (SELECT p_partkey AS node, p_brand AS a, p_size AS b, length(p_type) AS c FROM part) SELECT node, round(1.0 / count(*) OVER (PARTITION BY a, b) + 1.0 / count(*) OVER (PARTITION BY a, c) + 1.0 / count(*) OVER (PARTITION BY b, c), 6) AS val FROM p",
        "granularity": f"WITH {SIZE}, s AS (SELECT count(*) AS z FROM sz GROUP BY cluster), o AS (SELECT z, row_number() OVER (ORDER BY z) AS i, sum(z) OVER (ORDER BY z ROWS UNBOUNDED PRECEDING) AS run FROM s), a AS (SELECT count(*) AS clusters, max(z) AS largest, sum(z) AS total FROM s) SELECT clusters, largest, (SELECT round(sum(z * z) / sum(z), 6) FROM s) AS ctr, (SELECT round(avg(z), 6) FROM s) AS mean, (SELECT min(z) FROM s) AS smallest, (SELECT count(*) FROM s WHERE z <= 1) AS singletons, (SELECT count(*) FROM s WHERE z <= 4) AS quartets, (SELECT round(-sum(z * ln(z)), 6) FROM s) AS log_variance, (SELECT min(i) FROM o WHERE run >= largest) AS dgi, clusters - (SELECT min(i) FROM o WHERE run >= (total + 1) // 2) AS twi, (SELECT min(z) FROM o WHERE run >= (total + 1) // 2) AS twl FROM a",
        "cluster_performance": f"WITH {parts('gg')}, {BRAND}, {SCORES} SELECT round(avg(cov), 6) AS efficiency, round(avg(covmax), 6) AS max_efficiency, round(avg(mf), 6) AS massfrac, round((SELECT sum(size * (size - 1)) FROM cs) / (count(*) * (count(*) - 1)), 6) AS areafrac FROM ns",
        "cluster_scores": f"WITH {parts('gg')}, {BRAND}, {SCORES} SELECT cluster, count(*) AS size, round(avg(cov) + 1e-9, 6) AS cov, round(avg(covmax) + 1e-9, 6) AS covmax, round(avg(mf) + 1e-9, 6) AS massfrac FROM ns GROUP BY cluster",
        "cluster_projection": g + f", {BRAND}, p AS (SELECT col_id, b.cluster AS b, sum(val) AS w FROM g JOIN brand b ON b.node = row_id GROUP BY ALL), t AS (SELECT col_id, sum(val) AS t FROM g GROUP BY col_id), k AS (SELECT cluster, count(*) AS n FROM brand GROUP BY cluster) SELECT a.cluster AS a, p.b, round(sum(w / t) / any_value(n) + 1e-9, 6) AS val FROM p JOIN t USING (col_id) JOIN brand a ON a.node = col_id JOIN k ON k.cluster = a.cluster GROUP BY a.cluster, p.b",
        "residue_nodes": g + f", {BRAND}, known AS (SELECT cluster, node FROM brand SEMI JOIN (SELECT p_partkey AS node FROM part WHERE p_size <= 25) USING (node)), w AS (SELECT col_id AS node, cluster, sum(val) AS w FROM g JOIN known ON known.node = row_id WHERE col_id NOT IN (SELECT node FROM known) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, cluster) AS k FROM w) SELECT cluster, node FROM known UNION ALL SELECT cluster, node FROM r WHERE k = 1",
        "enstrict_cut": f"WITH {ODD}, k AS (SELECT node, min(cluster) AS c FROM ov GROUP BY node) SELECT min(node) OVER (PARTITION BY c) AS cluster, node FROM k UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 2 = 0",
        "enstrict_split": f"WITH {ODD}, k AS (SELECT node, list_sort(list(DISTINCT cluster)) AS c FROM ov GROUP BY node) SELECT min(node) OVER (PARTITION BY c) AS cluster, node FROM k UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 2 = 0",
        "stack_to_cone": f"WITH {PLACES} SELECT level, cluster, node FROM h WHERE level = 0 UNION ALL SELECT DISTINCT 1, r, n FROM pl UNION ALL SELECT DISTINCT 2, 0, r FROM pl",
        "cone_to_stack": f"WITH {PLACES} SELECT level, cluster, node FROM h",
        "stable_clusters": f"WITH {PLACES}, s AS (SELECT level, cluster, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT a.level, a.cluster, b.cluster AS upper, count(*) AS m FROM h a JOIN h b ON a.node = b.node AND b.level = a.level + 1 GROUP BY ALL), i AS (SELECT m.level, m.cluster, upper, m / (x.n + y.n - m) AS identity FROM m JOIN s x ON x.level = m.level AND x.cluster = m.cluster JOIN s y ON y.level = m.level + 1 AND y.cluster = upper), r AS (SELECT *, row_number() OVER (PARTITION BY level, upper ORDER BY identity DESC, cluster) AS k FROM i) SELECT level, cluster, upper, round(identity, 6) AS identity FROM r WHERE k = 1 AND identity > 0.2",
        "coarse_graph": g + f", {BRAND}, o AS (SELECT col_id, row_id, val, a.cluster AS ca, b.cluster AS cb FROM g JOIN brand a ON a.node = col_id JOIN brand b ON b.node = row_id WHERE a.cluster <> b.cluster), k AS (SELECT cluster, count(*) AS n FROM brand GROUP BY cluster) SELECT ca AS col_id, cb AS row_id, round(sum(val / n) + 1e-9, 6) AS val FROM o JOIN k ON k.cluster = ca GROUP BY ca, cb",
        "load_labels": f"WITH a AS (SELECT x, y, CASE WHEN val IS NULL OR isnan(val) OR abs(val) > {MAXF} THEN 1.0 ELSE val END AS val FROM tree_pairs WHERE coalesce(x, '') <> '' AND coalesce(y, '') <> '' AND NOT ltrim(x) LIKE '#%'), b AS (SELECT x, y, val FROM a UNION ALL SELECT y, x, val FROM a) SELECT x, y, round(max(val), 6) AS val FROM b GROUP BY x, y HAVING max(val) <> 0",
        "load_numbers": "SELECT col_id, row_id, round(max(v), 6) AS val FROM (SELECT col_id, row_id, CASE WHEN val IS NULL OR isnan(val) THEN 1.0 ELSE val END AS v FROM cells WHERE col_id >= 0 AND row_id >= 0) GROUP BY ALL HAVING max(v) <> 0",
        "load_adjacency": "SELECT DISTINCT l_orderkey AS col_id, l_partkey AS row_id, 1.0::DOUBLE AS val FROM lineitem",
        "load_tab": r"SELECT CAST(regexp_extract(raw_line, '^\s*([0-9]+)\s+(.*?)\r?$', 1) AS BIGINT) AS id, count(*) AS n, min(regexp_extract(raw_line, '^\s*([0-9]+)\s+(.*?)\r?$', 2)) AS first_label FROM tab_lines WHERE regexp_matches(raw_line, '^\s*([0-9]+)\s+(.*?)\r?$') AND NOT regexp_matches(raw_line, '^\s*#') GROUP BY 1",
        "dump_lines": f"WITH {NET} SELECT CAST(n_nationkey AS BIGINT) AS id, concat_ws(chr(9), CAST(n_nationkey AS VARCHAR), l) AS line FROM nation LEFT JOIN (SELECT col_id, string_agg(CAST(row_id AS VARCHAR), chr(9) ORDER BY row_id) AS l FROM net GROUP BY col_id) ON col_id = n_nationkey",
        "dump_table": f"WITH {TRADE} SELECT CAST(n_nationkey AS BIGINT) AS id, " + ", ".join(f"coalesce(max(val) FILTER (WHERE row_id = {i}), 0) AS r{i}" for i in range(4)) + " FROM nation LEFT JOIN t ON col_id = n_nationkey GROUP BY n_nationkey",
        "dump_half": f"WITH {TRADE} SELECT CAST(col_id AS VARCHAR) AS x, CAST(row_id AS VARCHAR) AS y, val FROM t WHERE row_id < col_id AND val >= 5",
        "tab_lookup": "SELECT id, coalesce(l, '?') AS label FROM coldom LEFT JOIN (SELECT id AS i, min(label) AS l FROM tab WHERE label IS NOT NULL GROUP BY id) ON id = i",
        "tab_duplicated": "SELECT label, count(DISTINCT id) AS n, min(id) AS first_id FROM tab WHERE label IS NOT NULL GROUP BY label HAVING count(DISTINCT id) > 1",
        "tab_algebra": "WITH a AS (SELECT DISTINCT label FROM tab WHERE id % 2 = 0 AND label IS NOT NULL), b AS (SELECT DISTINCT label FROM tab WHERE id % 3 = 0 AND label IS NOT NULL) SELECT 'meet' AS how, label FROM a SEMI JOIN b USING (label) UNION ALL SELECT 'merge', label FROM (SELECT label FROM a UNION SELECT label FROM b) UNION ALL SELECT 'left', label FROM a ANTI JOIN b USING (label)",
        "alignments": "SELECT x, y, max(val) AS val FROM (SELECT 'p' || l_partkey AS x, 's' || l_suppkey AS y, least(200, CAST(l_quantity AS INTEGER))::DOUBLE AS val FROM lineitem) WHERE val > 5 GROUP BY ALL",
        "block_spec": g + f", {BRAND} SELECT row_id AS col_id, col_id AS row_id, val * 2 AS val FROM g WHERE col_id IN (SELECT node FROM brand WHERE cluster IN (11, 12, 13)) AND row_id > 100",
        "block_sizes": m + ", n AS (SELECT col_id FROM g GROUP BY col_id HAVING count(*) BETWEEN 2 AND 5) SELECT col_id, row_id, 1.0::DOUBLE AS val FROM g SEMI JOIN n USING (col_id)",
        "stack_program": f"WITH {TRADE}, m AS (SELECT col_id, row_id, val / sum(val) OVER (PARTITION BY col_id) AS val FROM t), q AS (SELECT b.col_id, a.row_id, sum(a.val * b.val) AS val FROM m b JOIN m a ON a.col_id = b.row_id GROUP BY ALL), z AS (SELECT col_id, row_id, pow(val, 1.5) / sum(pow(val, 1.5)) OVER (PARTITION BY col_id) AS val FROM q) SELECT col_id, row_id, round(sum(val), 6) AS val FROM (SELECT * FROM z UNION ALL SELECT row_id, col_id, val FROM z) GROUP BY ALL",
        "random_removal": "SELECT CAST(100 AS BIGINT) AS n_removed",
        "random_swaps": g + "SELECT col_id, count(*) AS degree FROM g GROUP BY col_id",
        "stream_arcs": f"SELECT x, y, max(v) AS val FROM (SELECT x, y, CASE WHEN val IS NULL OR isnan(val) OR abs(val) > {MAXF} THEN 1.0 ELSE val END AS v FROM tree_pairs WHERE x <> '' AND y <> '') GROUP BY ALL HAVING max(v) <> 0",
    }
