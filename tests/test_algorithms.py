import pytest
from pyspark.sql import functions as F

import reference_graphs as R
from graphspark.functions import verify
from graphspark.operators import colouring, components, flow, labels, paths, ranking, scc, walks
from graphspark.operators.transforms import symmetrize

INF = paths.INFINITY


@pytest.fixture(scope="module")
def m1(spark):
    return R.m1(spark).validate().stored()


def listed(df, name):
    return [v for _, v in sorted(R.column(df, name).items())]


def test_levels_and_distances(m1):
    assert listed(paths.bfs(m1, 0), "level") == [1, 2, 2, 3, 4, -1, -1, -1]
    assert listed(paths.bfs(m1, 0, strategy="auto"), "level") == [1, 2, 2, 3, 4, -1, -1, -1]
    assert listed(paths.sssp(m1, 0), "distance") == [0, 3, 1, 8, 11, INF, INF, INF]
    assert listed(paths.sswp(m1, 0), "width") == [INF, 6, 1, 5, 3, 0, 0, 0]


def test_components(m1):
    assert listed(components.connected_components(m1), "component") == [0, 0, 0, 0, 0, 5, 5, 7]
    assert listed(components.numbered(components.connected_components(m1, "bfs")), "component") == [1, 1, 1, 1, 1, 2, 2, 3]
    assert listed(scc.strong_components(m1), "component") == [0, 1, 2, 1, 4, 5, 6, 7]


def test_rankings(m1):
    assert [round(x, 6) for x in listed(ranking.page_rank(m1, 5), "rank")] == [0.051296, 0.256802, 0.066245, 0.256618, 0.170305, 0.051296, 0.096141, 0.051296]
    assert [round(x, 6) for x in listed(ranking.page_rank(m1, 5, "transpose"), "rank")] == [0.236626, 0.193774, 0.105774, 0.159528, 0.062636, 0.116390, 0.062636, 0.062636]
    h = ranking.hits(m1, 3)
    assert [round(x, 6) for x in listed(h, "authority")] == [0, 0.878320, 0.459373, 0.003675, 0.132299, 0, 0.003675, 0]
    assert [round(x, 6) for x in listed(h, "hub")] == [0.797482, 0.001323, 0.481399, 0.363694, 0, 0.001323, 0, 0]


def test_colours_labels_walks_flow(spark, m1):
    assert listed(colouring.colour(m1), "colour") == [0, 1, 2, 0, 1, 0, 1, 0]
    assert verify.colour_conflicts(m1, colouring.colour(m1)).isEmpty()
    for n, want in ((1, [1, 3, 2, 4, 4, 6, 6, 7]), (2, [3, 4, 3, 4, 4, 6, 6, 7]), (3, [4, 4, 4, 4, 4, 6, 6, 7])):
        assert listed(labels.label_propagation(m1, n), "label") == want
    starts = m1.vertices.select(F.col("id").alias("walk"), "id")
    walked = walks.random_walk(m1, starts, 3, paths=True)
    assert [r["end"] for r in walked.orderBy("walk").collect()] == [1, 3, 1, -1, -1, -1, -1, -1]
    assert walked.where("walk = 0").first()["path"][0] == 0
    value, flows = flow.max_flow(m1, 0, 4)
    assert value == 3 and flows.where("flow > capacity").isEmpty()
    with pytest.raises(ValueError):
        flow.max_flow(m1, 0, 0)


@pytest.mark.parametrize("method", ["condensed", "bfs"])
def test_reachable(spark, m1, method):
    pairs = spark.createDataFrame([(0, 0, 4), (1, 4, 0), (2, 5, 6), (3, 1, 3), (4, 7, 7)], "pair_id long, src long, dst long")
    assert [r["reachable"] for r in paths.reachable(m1, pairs, method).orderBy("pair_id").collect()] == [True, False, True, True, True]


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    n, arcs = 25, R.random_arcs(seed, 25, 45 + 20 * seed)
    g = R.graph(spark, arcs, n).stored()
    assert R.column(paths.bfs(g, arcs[0][0], strategy="pull"), "level") == R.bfs(n, arcs, arcs[0][0])
    assert R.column(paths.sssp(g, arcs[0][0], mode="all", direction="pull"), "distance") == R.dijkstra(n, arcs, arcs[0][0], INF)
    assert R.column(paths.sswp(g, arcs[0][0]), "width") == R.widest(n, arcs, arcs[0][0], INF)
    assert R.column(components.connected_components(g), "component") == R.components(n, arcs)
    assert R.column(scc.strong_components(g), "component") == R.strong(n, arcs)
    assert R.column(colouring.colour(g), "colour") == R.greedy_colours(n, arcs)
    want = R.page_rank(n, arcs, 4)
    got = R.column(ranking.page_rank(g, 4), "rank")
    assert all(abs(want[v] - got[v]) < 1e-12 for v in want) and abs(sum(got.values()) - 1) < 1e-12
    value, flows = flow.max_flow(g, 0, n - 1)
    assert value == R.edmonds_karp(n, arcs, 0, n - 1)
    balance = {}
    for r in flows.collect():
        balance[r["src"]] = balance.get(r["src"], 0) - r["flow"]
        balance[r["dst"]] = balance.get(r["dst"], 0) + r["flow"]
    assert all(abs(x) < 1e-9 for v, x in balance.items() if v not in (0, n - 1)) and abs(balance.get(n - 1, 0) - value) < 1e-9


def test_special_shapes(spark):
    cycle = R.graph(spark, [(i, (i + 1) % 5, 1) for i in range(5)], 5)
    assert set(R.column(scc.strong_components(cycle), "component").values()) == {0}
    empty = R.graph(spark, [], 3)
    assert R.column(components.connected_components(empty), "component") == {0: 0, 1: 1, 2: 2}
    assert R.column(scc.strong_components(empty), "component") == {0: 0, 1: 1, 2: 2}
    assert R.column(paths.bfs(empty, 1), "level") == {0: -1, 1: 1, 2: -1}
    assert R.column(ranking.hits(empty, 2), "hub") == {0: 0.0, 1: 0.0, 2: 0.0}
    bipartite = symmetrize(R.graph(spark, [(a, b, 1) for a in range(3) for b in range(3, 6)], 6))
    assert max(R.column(colouring.colour(bipartite), "colour").values()) == 1
    assert verify.equal_partitions(components.connected_components(cycle), components.numbered(components.connected_components(cycle)))


@pytest.mark.parametrize("activity", labels.ACTIVITIES)
def test_label_activity(spark, activity):
    g = symmetrize(R.graph(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)], 6))
    found = R.column(labels.label_propagation(g, 6, activity), "label")
    assert found[0] == found[1] == found[2] != found[3] == found[4] == found[5]
