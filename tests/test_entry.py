import subprocess
import sys
from pathlib import Path

from conftest import SF

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 100


def test_core_does_not_import_the_subpackage():
    code = "import sys; sys.modules['gridloom.llm'] = None; import __spark_entry__ as e; assert 'p3_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for f in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert "gridloom.llm" not in f.read_text()


def test_streamed_arcs(spark):
    from gridloom import queries

    got = queries.stream_arcs(spark, SF)
    want = spark.read.parquet(f"{SF}/tree_pairs.parquet").where("x <> '' AND y <> ''").select("x", "y").distinct()
    assert 0 < got.count() <= want.count()


def test_plans_prune_and_push_down(spark):
    from gridloom.operators import chunking

    plan = chunking.crowded_top_rows(spark.read.parquet(f"{SF}/cells.parquet"))._jdf.queryExecution().toString()
    assert "In(col_id" in plan or "EqualTo(col_id" in plan
    assert "loaded_at" not in plan.split("ReadSchema")[1].split(">")[0]
