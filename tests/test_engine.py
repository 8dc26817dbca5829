import pytest
from pyspark.sql import functions as F

import reference_graphs as R
from graphspark import cli
from graphspark.functions import analytics, metrics, rating, text, verify
from graphspark.graph import Graph
from graphspark.operators import components
from graphspark.operators import primitives as P
from graphspark.operators import transforms as T
from graphspark.sources import generators, store
from graphspark.sources import text as files
from graphspark.streaming.components import StreamingComponents


@pytest.fixture(scope="module")
def m1(spark):
    return R.m1(spark).stored()


def arcs(g):
    return sorted((r["src"], r["dst"]) for r in g.edges.select("src", "dst").collect())


def test_degrees_and_histogram(m1):
    assert [v for _, v in sorted(R.column(m1.degrees(), "degree").items())] == [3, 1, 2, 2, 0, 1, 0, 0]
    assert {r["bucket"]: r["vertices"] for r in analytics.degree_histogram(m1).collect()} == {-1: 3, 0: 2, 1: 3}
    r = analytics.degree_report(m1).first()
    assert (r["vertices"], r["edges"], r["average_degree"], r["highest"], r["zero_percent"]) == (8, 9, 1, 3, 37)


def test_transforms(spark, m1):
    assert arcs(T.transpose(m1)) == sorted((d, s) for s, d in arcs(m1))
    assert len(arcs(T.symmetrize(m1))) == 18
    assert len(arcs(T.remove_multi_arcs(m1))) == 8 and len(arcs(T.remove_loops(m1))) == 8
    order = {r["id"]: r["new_id"] for r in T.degree_order(m1).collect()}
    assert sorted(order, key=order.get) == [0, 2, 3, 1, 5, 4, 6, 7]
    shuffled = T.shuffle_labels(m1, 3)
    assert sorted(R.column(shuffled.degrees(), "degree").values()) == sorted(R.column(m1.degrees(), "degree").values())
    assert [(r["offset"], r["degree"]) for r in T.csr_offsets(m1).orderBy("id").collect()] == [(0, 3), (3, 1), (4, 2), (6, 2), (8, 0), (8, 1), (9, 0), (9, 0)]
    assert T.find_edges(m1, 0, 1).count() == 2 and T.count_with_arcs(m1) == 5
    assert T.random_vertex(m1, 1) in {0, 1, 2, 3, 5}
    rows = spark.createDataFrame([(0, 5), (1, 2), (2, 5)], "position long, k long")
    assert [r["position"] for r in T.sort_with_positions(rows, "k", True).collect()] == [0, 2, 1]
    assert T.count_if(rows, F.col("k") == 5) == 2
    swapped = T.permute(rows.withColumnRenamed("k", "value"), spark.createDataFrame([(0, 2), (1, 1)], "position long, source long"))
    assert {r["position"]: r["value"] for r in swapped.collect()} == {0: 5, 1: 2}


def test_primitives(spark, m1):
    state = m1.vertices.select("id", (F.col("id") + 1).alias("x"))
    assert R.column(P.scatter(m1, F.col("src_x"), "sum", state), "message") == {1: 1 + 1 + 3 + 4, 2: 1 + 3, 3: 2, 4: 4, 6: 6}
    assert R.column(P.gather(m1, F.col("dst_x"), "max", state, read_other=True), "message") == {1: 4, 2: 3, 3: 2, 4: 4, 6: 6}
    only = P.frontier_of(m1, 3)
    assert R.column(P.scatter(m1, F.col("weight"), "min", frontier=only), "message") == {1: 1.0, 4: 3.0}
    assert R.column(P.compute(state, only, x=F.col("x") * 10), "x")[3] == 40
    assert [P.reduce(state, F.col("x"), a) for a in ("sum", "min", "max", "avg")] == [36, 1, 8, 4.5]
    assert P.reduce(state, -F.col("x"), "max", only) == -4 and P.reduce(state.where("false"), F.col("x"), "max") is None
    assert sorted(r["id"] for r in P.new_frontier(state, F.col("x") > 6).collect()) == [6, 7]
    stats = P.frontier_stats(m1, P.frontier_of(m1, 0, 3)).first()
    assert (stats["size"], stats["neighbours"], stats["sparsity"]) == (2, 5, "SPARSE")
    assert P.frontier_stats(m1).first()["sparsity"] == "ALL_ACTIVE"
    both = state.withColumn("y", F.lit(0))
    assert set(P.unpack(P.pack(both, "x", "y")).columns) == {"id", "x", "y"}
    assert R.column(P.exchange([state.where("id < 2").withColumn("x", F.col("x") + 5)], "max", "x", state), "x")[1] == 7
    with pytest.raises(ValueError):
        P.fold("median", F.col("x"))


def test_validation(spark):
    with pytest.raises(ValueError):
        R.graph(spark, [(0, 9, 1)], 3).validate()
    with pytest.raises(ValueError):
        Graph(spark.range(2), spark.createDataFrame([(1,)], "src long")).validate()


def test_generators(spark):
    a, b = (generators.rmat(spark, 6, 200, seed=4) for _ in range(2))
    assert arcs(a) == arcs(b) and a.edges.count() == 200 and a.validate()
    assert generators.rmat(spark, 6, 100, directed=False, seed=1).edges.count() == 200
    assert generators.uniform(spark, 50, 300, seed=2).validate().vertices.count() == 50
    from graphspark.operators.scc import strong_components

    blocks = generators.strong_blocks(spark, 30, 10)
    assert R.column(strong_components(blocks), "component") == {v: v // 10 * 10 for v in range(30)}
    assert 0 <= generators.kronecker(spark, 5, 2).edges.agg(F.max("weight")).first()[0] < 1


def test_files(spark, m1, tmp_path):
    source = tmp_path / "edges.txt"
    source.write_text("% comment\n1 2 0.5\n2\t3\nbad line\n3 1 7 99\n")
    g = files.read_edge_list(spark, str(source), weighted=True)
    assert arcs(g) == [(1, 2), (2, 3), (3, 1)] and g.vertices.count() == 4
    assert files.read_edge_list(spark, str(source), directed=False).edges.count() == 6
    source.write_text("1 2\n" * 6 + "4 5\n")
    assert arcs(files.read_edge_list(spark, str(source), skip_lines=6)) == [(4, 5)]
    source.write_text("7 7\n1 2\n7 7\n")
    assert arcs(files.read_edge_list(spark, str(source), skip_lines=1)) == [(1, 2), (7, 7)]
    source.write_text("-1 2\n")
    with pytest.raises(ValueError):
        files.read_edge_list(spark, str(source))
    store.save(m1, str(tmp_path / "g"), sorted_by_source=True)
    assert arcs(store.load(spark, str(tmp_path / "g"))) == arcs(m1)
    store.write_container(m1, str(tmp_path / "g.el_container"))
    back = store.prepare(spark, "import", str(tmp_path / "g.el_container"))
    assert arcs(back) == arcs(m1) and back.vertices.count() == 8
    lines = [r["value"] for r in files.ligra_lines(m1).orderBy("section", "place", "other").collect()]
    assert lines == ["AdjacencyGraph", "8", "9", "0", "3", "4", "6", "8", "8", "9", "9", "1", "1", "2", "3", "1", "2", "1", "4", "6"]
    assert "1 2 4.0" in {r["value"] for r in files.edge_list_lines(m1, "weight", header=True).collect()}
    assert files.edge_list_lines(m1, header=True).first()["value"] == "9 9 9"
    assert files.dot_lines(m1)[1] == "0 -> 1;"
    assert "9 edges" in store.describe(m1)


def test_analytics_and_verify(spark, m1):
    cc = components.connected_components(m1)
    assert {r["size"]: r["components"] for r in components.size_histogram(cc).collect()} == {5: 1, 2: 1, 1: 1}
    r = analytics.component_report(cc).first()
    assert (r["components"], r["largest"], r["non_trivial"]) == (3, 5, 2)
    assert sum(r["share"] for r in analytics.sparsity_matrix(m1, 4).collect()) == pytest.approx(1)
    assert analytics.hub_share(m1).first()["share"] == pytest.approx(3 / 9, abs=1e-6)
    assert analytics.work_balance(m1).first()["most"] >= 1 and analytics.size_in_bytes(m1) > 0
    assert not verify.equal_values(cc, cc.withColumn("component", F.col("component") + 1), "component")
    assert verify.equal_partitions(cc, cc.withColumn("component", F.col("component") + 1))
    assert not verify.equal_partitions(cc, cc.withColumn("component", F.lit(0)))
    ranks = spark.createDataFrame([(0, 1e-9)], "id long, rank double")
    assert not verify.equal_rankings(ranks, ranks.withColumn("rank", F.col("rank") * 2))
    stats = metrics.PerformanceStats()
    with stats.round(1000), stats.timed("scatter"):
        pass
    assert stats.report()["avg_mteps"] > 0 and metrics.mteps(2_000_000, 1.0, 3) == 6


def test_rating(spark):
    rows = spark.createDataFrame([("bfs", "web_a", "x", 10.0), ("bfs", "web_a", "y", 5.0), ("pr", "syn_rmat_20_32", "y", 8.0)], "app_name string, graph_name string, arch_name string, perf_val double")
    got = {r["arch_name"]: (r["rating"], r["position"]) for r in rating.rating(rows).collect()}
    assert got == {"y": (0.75, 1), "x": (0.5, 2)}
    meta = {r["graph_name"]: (r["graph_category"], r["vertex_scale"]) for r in rating.enrich(rows, spark.createDataFrame([("web_a", 70000)], "graph_name string, vertices long")).collect()}
    assert meta == {"web_a": ("Hyperlink network", "small_vertex_scale"), "syn_rmat_20_32": ("synthetic", "small_vertex_scale")}
    assert rating.count_documents(rows, {"app_name": "bfs"}) == 2 and rating.find_one(rows).count() == 1
    assert rating.remove(rows, {"arch_name": "y"}).count() == 1
    assert rating.update_many(rows, {"arch_name": "x"}, {"perf_val": 1.0}).agg(F.min("perf_val")).first()[0] == 1.0
    assert rating.upsert_max(rows, rows.withColumn("perf_val", F.col("perf_val") + 1)).agg(F.max("perf_val")).first()[0] == 11
    assert rating.insert_many(rows, rows).count() == 6


def test_text(spark):
    html = '<html><title>T</title><script>var x = "<p>";</script><body><p>Size = 1,234 vertices</p><a href="a/b">x</a></body></html>'
    row = spark.createDataFrame([(html, "x\nAVG_PERF: 12.5 MTEPS\nerror count: 3\n")], "html string, log string").select(
        text.number_in(text.line_with(text.page_text(F.col("html")), "Size")).alias("n"), text.links(F.col("html")).alias("links"), text.title(F.col("html")).alias("t"), text.performance(F.col("log")).alias("p"), text.error_count(F.col("log")).alias("e"), text.without_prefix(F.lit("Category web"), "Category").alias("c"),
    ).first()
    assert (row["n"], row["links"], row["t"], row["p"], row["e"], row["c"]) == (1234, ["a/b"], "T", 12.5, 3, "web")


def test_streaming_components(spark):
    s = StreamingComponents(spark)
    for batch in ([(0, 1), (2, 3)], [(4, 5)], [(3, 0), (5, 4)]):
        s.add(spark.createDataFrame(batch, "src long, dst long"))
    assert R.column(s.state, "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}


def test_stream_of_edges(spark, tmp_path):
    for k, batch in enumerate(([(0, 1)], [(1, 2), (7, 8)])):
        spark.createDataFrame(batch, "src long, dst long").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    s = StreamingComponents(spark)
    q = s.start(spark.readStream.schema("src long, dst long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "progress"))
    q.processAllAvailable()
    q.stop()
    assert R.column(s.state, "component") == {0: 0, 1: 0, 2: 0, 7: 7, 8: 7}


@pytest.mark.parametrize("app", cli.APPS)
def test_cli_checks(spark, tmp_path, capsys, app):
    assert cli.main(["run", app, "-gen", "-s", "4", "-e", "3", "-it", "2", "-check"]) == 0
    out = capsys.readouterr().out
    assert "AVG_PERF:" in out and "error count: 0" in out


def test_loops_move_no_arcs(spark):
    """Arcs stored by their join key aren't shuffled again, even if nothing is broadcast."""
    from graphspark.plans.tables import bucketed

    g = generators.uniform(spark, 500, 4000, seed=3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arcs = bucketed(g.edges, "arcs", "src")
        sent = g.vertices.select(F.col("id").alias("src")).join(arcs, "src").groupBy("dst").count()
        plan = sent._jdf.queryExecution().executedPlan().toString()
        arcs_by_end = bucketed(g.edges, "arcs", "dst")
        pulled = arcs_by_end.join(F.broadcast(g.vertices.select(F.col("id").alias("src"))), "src").groupBy("dst").count()
        other = pulled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One exchange of the vertices and one of the messages; pulling needs the broadcast alone.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") == 1
    assert other.count("Exchange hashpartitioning") == 0 and other.count("BroadcastExchange") == 1


def test_searches_of_any_size_agree(spark, monkeypatch):
    """One table of all vertices and several hops in a job, one hop in a job, and a table of what each iteration finds."""
    from graphspark.operators import paths
    from graphspark.plans import loop

    g = generators.uniform(spark, 60, 150, seed=5)
    g = Graph(g.vertices, g.edges.withColumn("weight", F.pmod(F.col("src") * 7 + F.col("dst") * 3, F.lit(11)).cast("double"))).stored()

    def found():
        runs = paths.bfs(g, 0), paths.bfs(g, 0, strategy="pull"), paths.sssp(g, 0), paths.sssp(g, 0, mode="all", direction="pull"), paths.sswp(g, 0)
        return [sorted(map(tuple, r.collect())) for r in runs]

    small = found()
    assert small[0] == small[1] and small[2] == small[3]
    monkeypatch.setattr(paths, "SMALL_ARCS", 0)
    assert found() == small
    monkeypatch.setattr(loop, "WHOLE_ROWS", 0)
    assert found() == small


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["convert", "-gen", "-s", "4", "-e", "3", "-o", str(tmp_path / "g")]) == 0
    assert cli.main(["run", "bfs", "-load", str(tmp_path / "g"), "-check"]) == 0
    out = capsys.readouterr().out
    assert "AVG_PERF:" in out and "error count: 0" in out
