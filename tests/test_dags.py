from pyspark.sql import functions as F

from gridloom.operators import clusters, dags, flow
from gridloom.plans import ordering, pipelines
from gridloom.sources import labels
from gridloom.streaming import arcs


def test_levels_and_cycles(graph):
    m = graph({(0, 1): 1, (1, 2): 1, (0, 3): 1, (4, 5): 1, (5, 4): 1}, range(7))
    got = {r.node: (r.up, r.down, r.n_out, r.n_in, r.component_size) for r in dags.levels(m).collect()}
    assert got == {0: (2, 0, 2, 0, 4), 1: (1, 1, 1, 1, 4), 2: (0, 2, 0, 1, 4), 3: (0, 1, 0, 1, 4), 4: (-1, -1, 1, 1, 2), 5: (-1, -1, 1, 1, 2), 6: (0, 0, 0, 0, 1)}
    assert dags.has_cycle(m) and not dags.has_cycle(graph({(0, 1): 1}, range(2)))
    assert {(r.level, r.node) for r in dags.walk(m, 0).collect()} == {(0, 0), (1, 1), (1, 3), (2, 2)}


def test_cross_ratio_and_children(graph, as_dict):
    m = graph({(0, 0): 5, (1, 1): 4, (0, 1): 3, (1, 0): 6, (1, 2): 1}, range(3))
    assert {(r.x, r.y) for r in dags.cross_ratio(m).collect()} == {(0, 1), (1, 0)}
    d = graph({(0, 1): 0.1, (1, 0): 0.9, (1, 2): 0.4, (2, 1): 0.5}, range(3))
    assert as_dict(dags.select_children(d, 0.2, 0.8)) == {(0, 1): 0.8}


def test_shadows_double_the_domain(graph):
    m = graph({(a, b): 1.0 for a in range(5) for b in range(5) if a != b and 0 in (a, b)}, range(5))
    f = flow.shadow_factors(m)
    assert {r.id: r.val for r in f.collect()} == {0: 3.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    s = flow.shadow(m, f, 100)
    assert s.cols.count() == 10 and s.cells.count() == m.cells.count() + 3


def test_positions_and_running_sums(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 501).alias("v"), F.lit(2).alias("w")).repartition(7)
    got = sorted((r.v, r.position) for r in ordering.number(df, ["v"], start=10).collect())
    assert [p for _, p in got] == list(range(10, 510))
    run = sorted((r.v, r.before) for r in ordering.running(df, [F.desc("v")], "w").collect())
    assert [b for _, b in run] == [2 * (499 - i) for i in range(500)]
    assert ordering.number(df.limit(0), ["v"]).count() == 0


def test_pipeline_from_lines(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    lines = spark.createDataFrame([(f"{p} {q} {0.1 if (p, q) == ('c', 'x') else 1}",) for p, q in pairs], "value string")
    got = pipelines.label_lines(pipelines.cluster_lines(lines, spec="gq(0.2)"))
    assert {(r.cluster, r.line) for r in got.collect()} == {("a", "a\tb\tc"), ("x", "x\ty\tz")}


def test_projection_adjustment_and_residue(graph, spark):
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3), (6, 3), (6, 4)]
    m = graph({k: 1.0 for a, b in edges for k in ((a, b), (b, a))}, range(7))
    cl = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (2, 6)], "cluster bigint, node bigint")
    as_map = lambda d: {r.node: r.cluster for r in d.collect()}
    assert as_map(clusters.assimilate(m, cl, 1))[6] == 1
    assert as_map(clusters.adjust(m, cl, 1))[6] == 1
    assert as_map(clusters.residue(m, cl.where("cluster < 2")))[6] == 1
    share = {(r.node, r.cluster): r.val for r in clusters.projection(m, cl).collect()}
    assert abs(sum(v for (n, _), v in share.items() if n == 3) - 1) < 1e-9
    assert clusters.prune_projection(clusters.projection(m, cl), 0.5).where("node = 0").count() == 1


def test_collected_values(spark):
    t = lambda *x: spark.createDataFrame(x, "label string, val double")
    a, b = t(("x", 1.0), ("y", 2.0)), t(("y", 5.0), ("z", 7.0))
    assert {r.label: r.val for r in labels.collect_values([a, b]).collect()} == {"x": 1, "y": 7, "z": 7}
    s = labels.value_summary(labels.collect_values([a, b])).first()
    assert (s.least, s.median, s.most, s.mean) == (1, 7, 7, 5)


def test_windowed_stream_merges_and_upserts(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("2021-01-01 00:00:01", "a b 1"), ("2021-01-01 00:00:05", "a b 3"), ("2021-01-01 01:00:00", "a b 2"), ("2021-01-01 03:00:00", "c d 1")]
    spark.createDataFrame(rows, "t string, value string").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(f"file://{src}")
    stream = spark.readStream.schema("t timestamp, value string").parquet(f"file://{src}")
    timed = stream.withColumn("f", F.split("value", " ")).select("t", F.col("f")[0].alias("x"), F.col("f")[1].alias("y"), F.col("f")[2].cast("double").alias("val"))
    q = arcs.start(arcs.windowed(timed, "t", "10 minutes", "1 minute"), "win", "append")
    q.processAllAvailable()
    q.stop()
    assert {(r.x, r.y, r.val) for r in spark.table("win").collect()} == {("a", "b", 3.0), ("a", "b", 2.0)}
    q = arcs.upsert(arcs.merged(arcs.arcs(stream)), f"file://{tmp_path}/out")
    q.processAllAvailable()
    q.stop()
    assert {(r.x, r.y, r.val) for r in arcs.latest(spark, f"file://{tmp_path}/out").collect()} == {("a", "b", 3.0), ("c", "d", 1.0)}
