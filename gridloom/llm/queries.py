"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import groups, linkage, mixing, residue, setjoin, tokens, vectortree


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members, _ = setjoin.set_join(setjoin.item_sets(_t(spark, d, "array_cells")), Fraction(3, 5))
    return setjoin.expand_pairs(pairs, members).select(F.col("a").alias("item_a"), F.col("b").alias("item_b"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    rows = setjoin.item_sets(_t(spark, d, "array_cells"))
    pairs, members, _ = setjoin.set_join(rows, Fraction(3, 5))
    out = setjoin.record_links(pairs, members, rows.where("id IS NOT NULL AND tok IS NOT NULL").select("id").distinct())
    return out.select(F.col("id").alias("item"), "class_id", "n_links")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_records(_t(spark, d, "tree_pairs"))


def p2_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_records(_t(spark, d, "tree_pairs")).groupBy("group_label").agg(F.count("*").alias("n_records"), F.max("label").alias("last_label"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    of, _, _ = linkage.group_of(_t(spark, d, "cells"), _t(spark, d, "coldom"))
    return linkage.group_pairs(of)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return linkage.describe_groups(_t(spark, d, "cells"), _t(spark, d, "coldom"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near, _ = vectortree.most_similar(_t(spark, d, "profile_rows"), k=10, least=0.9, recall=0.995)
    return near.select(F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b")).distinct()


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Queries are all items whose id is divisible by 100, against all items."""
    near, _ = vectortree.most_similar(_t(spark, d, "profile_rows"), k=10, every=100, recall=0.95)
    return near.select("item", "other", F.col("rank").cast("int").alias("rank"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_t(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    counted, listed = mixing.weigh(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))
    return mixing.fair_mix(counted, listed)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), _t(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_t(spark, d, "documents")).select("doc_id")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_TOKENS = """s AS (SELECT DISTINCT item, attr FROM array_cells WHERE is_na = false AND val IS NOT NULL AND NOT isnan(val) AND val <> 0 AND item IS NOT NULL AND attr IS NOT NULL),
  n AS (SELECT item, count(*) AS n FROM s GROUP BY item),
  p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS o FROM s a JOIN s b ON a.attr = b.attr AND a.item < b.item GROUP BY ALL),
  j AS (SELECT item_a, item_b FROM p JOIN n x ON x.item = item_a JOIN n y ON y.item = item_b WHERE o * 5 >= 3 * (x.n + y.n - o))"""


_LINKS = """RECURSIVE r AS (SELECT DISTINCT x AS label FROM tree_pairs WHERE x IS NOT NULL UNION SELECT y FROM tree_pairs WHERE y IS NOT NULL),
  e AS (SELECT x AS a, y AS b FROM tree_pairs WHERE x IS NOT NULL AND y IS NOT NULL AND val >= 0.5 AND NOT isnan(val) UNION SELECT y, x FROM tree_pairs WHERE x IS NOT NULL AND y IS NOT NULL AND val >= 0.5 AND NOT isnan(val)),
  walk AS (SELECT label, label AS top FROM r UNION SELECT b, top FROM walk JOIN e ON label = a),
  g AS (SELECT label, min(top) AS group_label FROM walk GROUP BY label)"""

_COLUMNS = """s AS (SELECT DISTINCT col_id, row_id FROM cells SEMI JOIN (SELECT id AS col_id FROM coldom) USING (col_id) WHERE row_id IS NOT NULL AND val IS NOT NULL AND val <> 0),
  n AS (SELECT col_id, count(*) AS n FROM s GROUP BY col_id),
  p AS (SELECT a.col_id AS col_a, b.col_id AS col_b, count(*) AS o FROM s a JOIN s b ON a.row_id = b.row_id AND a.col_id < b.col_id GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_TOKENS} SELECT item_a, item_b FROM j",
        "p1_links": f"""WITH {_TOKENS}, z AS (SELECT item, list_sort(list(attr)) AS l FROM s GROUP BY item), k AS (SELECT item, min(item) OVER (PARTITION BY l) AS class_id FROM z),
          b AS (SELECT item_a AS item FROM j UNION ALL SELECT item_b FROM j) SELECT item, class_id, count(b.item) AS n_links FROM k LEFT JOIN b USING (item) GROUP BY item, class_id""",
        "p2_found": f"WITH {_LINKS} SELECT label, group_label FROM g",
        "p2_group_sizes": f"WITH {_LINKS} SELECT group_label, count(*) AS n_records, max(label) AS last_label FROM g GROUP BY group_label",
        "p4_found": f"WITH {_COLUMNS} SELECT col_a, col_b FROM p JOIN n x ON x.col_id = col_a JOIN n y ON y.col_id = col_b WHERE o * 20 >= 9 * (x.n + y.n - o)",
    }
