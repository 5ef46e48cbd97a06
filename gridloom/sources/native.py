"""The interchange text format, and Parquet as the native one.

Native: a folder with ``cells`` (sorted by column, so that a read of a few
columns skips row groups), ``cols`` and ``rows``. Interchange files are read by
the engine as text split at the record sign ``$``, which cuts even one large
file into columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.matrix import Matrix, within

# fixed values of the interchange format: section names
HEADER, COLS, ROWS, BOTH, BODY, TYPE = "mclheader", "mclcols", "mclrows", "mcldoms", "mclmatrix", "mcltype"


def write(m: Matrix, path: str) -> None:
    m.cells.repartitionByRange("col_id").sortWithinPartitions("col_id", "row_id").write.mode("overwrite").parquet(f"{path}/cells")
    m.cols.select("id").write.mode("overwrite").parquet(f"{path}/cols")
    m.rows.select("id").write.mode("overwrite").parquet(f"{path}/rows")


def read(spark: SparkSession, path: str, cols: list[int] | None = None, rows: list[int] | None = None, skeleton: bool = False) -> Matrix:
    """A native matrix; ``cols`` and ``rows`` lists reach the scan as filters, ``skeleton`` reads the domains only."""
    c, d, r = (spark.read.parquet(f"{path}/{x}") for x in ("cells", "cols", "rows"))
    if skeleton:
        return Matrix(c.limit(0), d, r)
    if cols is not None:
        c, d = c.where(F.col("col_id").isin(cols)), d.where(F.col("id").isin(cols))
    if rows is not None:
        c, r = c.where(F.col("row_id").isin(rows)), r.where(F.col("id").isin(rows))
    return Matrix(c, d, r)


def read_extended(spark: SparkSession, path: str, cols: list[int], rows: list[int]) -> Matrix:
    """Cells with a listed column or a listed row, domains whole."""
    c, d, r = (spark.read.parquet(f"{path}/{x}") for x in ("cells", "cols", "rows"))
    return Matrix(c.where(F.col("col_id").isin(cols) | F.col("row_id").isin(rows)), d, r)


def _dom(text: str, key: str) -> list[int] | None:
    m = re.search(rf"\(\s*{key}\s+([\d\s]*)\$\s*\)", text)
    return [int(x) for x in m.group(1).split()] if m else None


def dimensions(text: str) -> tuple[int, int]:
    """(rows, columns) of an interchange header."""
    m = re.search(r"dimensions\s+(\d+)x(\d+)", text)
    if not m:
        raise ValueError("no dimensions in header")
    return int(m.group(1)), int(m.group(2))


def parse_interchange(records: DataFrame) -> DataFrame:
    """(col_id, row_id, val) of records ``id idx[:val] ...`` (``value``), as they lie between ``$`` signs."""
    f = records.select(F.split(F.regexp_replace("value", "^\\s+|\\s+$", ""), "\\s+").alias("f")).where(F.col("f")[0].rlike("^\\d+$"))
    e = f.select(F.col("f")[0].cast("bigint").alias("col_id"), F.explode(F.slice("f", F.lit(2), F.size("f"))).alias("e")).where("e <> ''")
    p = F.split("e", ":")
    return e.select("col_id", p[0].cast("bigint").alias("row_id"), F.coalesce(F.get(p, F.lit(1)).cast("double"), F.lit(1.0)).alias("val"))


def read_interchange(spark: SparkSession, path: str) -> Matrix:
    """An interchange file. The header and domains, which precede the body, are read on the driver; the body is split at ``$`` by the text source and parsed in place."""
    head = ""
    for row in spark.read.text(path, lineSep="\n").where("value IS NOT NULL").toLocalIterator():
        head += row.value + "\n"
        if "begin" in row.value:
            break
    n_rows, n_cols = dimensions(head)
    both = _dom(head, BOTH)

    def dom(own: list[int] | None, n: int) -> DataFrame:
        ids = own if own is not None else both
        return spark.range(n) if ids is None else spark.createDataFrame([(i,) for i in ids], "id bigint")

    cols, rows = dom(_dom(head, COLS), n_cols), dom(_dom(head, ROWS), n_rows)
    body = spark.read.text(path, lineSep="$")
    body = body.select(F.regexp_replace("value", "(?s)^.*begin", "").alias("value"))
    body = body.select(F.regexp_replace("value", "(?m)^\\s*#.*$", "").alias("value")).where(~F.col("value").rlike(rf"\((?:{HEADER}|{COLS}|{ROWS}|{BOTH}|{BODY})"))
    c = within(parse_interchange(body), cols, rows)
    return Matrix(c.where("val <> 0"), cols, rows)


def interchange_lines(m: Matrix, digits: int = 6) -> DataFrame:
    """(part, id, line): header, domains and columns of an interchange file in order of part and id."""
    spark = m.cells.sparkSession
    r, c = m.rows.count(), m.cols.count()
    text = lambda part, s: spark.createDataFrame([(part, 0, s)], "part int, id bigint, line string")
    ids = lambda d: d.agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " ").alias("s"))
    dom = lambda part, key, d: ids(d).select(F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("id"), F.concat(F.lit(f"({key}\n"), "s", F.lit(" $\n)")).alias("line"))
    v = F.round("val", digits)
    cell = F.concat(F.col("row_id").cast("string"), F.when(v == 1, "").otherwise(F.concat(F.lit(":"), v.cast("string"))))
    body = m.cells.groupBy("col_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", cell.alias("t")))), lambda x: x["t"]), " ").alias("t"))
    body = body.select(F.lit(5).alias("part"), F.col("col_id").alias("id"), F.concat(F.col("col_id").cast("string"), F.lit("  "), "t", F.lit(" $")).alias("line"))
    out = text(1, f"({HEADER}\n{TYPE} matrix\ndimensions {r}x{c}\n)").unionByName(dom(2, ROWS, m.rows)).unionByName(dom(3, COLS, m.cols)).unionByName(text(4, f"({BODY}\nbegin")).unionByName(body)
    return out.unionByName(text(6, ")"))


def write_interchange(m: Matrix, path: str, digits: int = 6) -> None:
    """A folder of text parts that concatenate to one interchange file."""
    interchange_lines(m, digits).repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("line").write.mode("overwrite").text(path)
