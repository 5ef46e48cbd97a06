import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tests-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def graph(spark):
    """A matrix out of {(col, row): val}, square unless told otherwise."""
    from gridloom.matrix import Matrix

    def make(cells, nodes=None, rows=None):
        df = spark.createDataFrame([(c, r, float(v)) for (c, r), v in cells.items()], "col_id bigint, row_id bigint, val double")
        dom = None if nodes is None else spark.createDataFrame([(i,) for i in nodes], "id bigint")
        if rows is not None:
            return Matrix(df, dom, spark.createDataFrame([(i,) for i in rows], "id bigint"))
        return Matrix.graph(df, dom)

    return make


@pytest.fixture(scope="session")
def as_dict():
    return lambda m: {(r.col_id, r.row_id): r.val for r in m.cells.collect()}
