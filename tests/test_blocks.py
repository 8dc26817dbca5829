"""Loops over blocks of arcs: hops aren't jobs, and any number of blocks gives the same results."""

import itertools

import pytest

import reference_graphs as R
from graphspark.operators import colouring, components, flow, paths, scc
from graphspark.plans import loop

_groups = itertools.count()


def jobs_of(spark, run):
    """How many jobs a call takes until its result is written."""
    group = f"counted-{next(_groups)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run().write.format("noop").mode("overwrite").save()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture(scope="module")
def path(spark):
    """A path of 300 hops."""
    return R.graph(spark, [(i, i + 1, 1 + i % 7) for i in range(300)], 301).stored()


def test_hops_of_searches_are_no_jobs(spark, path):
    for run in (lambda: paths.bfs(path, 0), lambda: paths.bfs(path, 0, strategy="pull"), lambda: paths.sssp(path, 0), lambda: paths.sssp(path, 0, mode="all", direction="pull"), lambda: paths.sswp(path, 0)):
        assert jobs_of(spark, run) < 36
    assert R.column(paths.bfs(path, 0, strategy="auto"), "level") == {i: i + 1 for i in range(301)}


@pytest.mark.parametrize("method", ["condensed", "bfs"])
def test_many_pairs_in_blocks(spark, monkeypatch, method):
    """More pairs than one search takes, in one block and in several; repeated pairs and pairs of one vertex too."""
    n, arcs = 40, R.random_arcs(7, 40, 60)
    g = R.graph(spark, arcs, n).stored()
    after = {v: {v} for v in range(n)}
    for _ in range(n):
        for a, b, *_ in arcs:
            after[a] |= after[b]
    rows = [(i, i * 7 % n, i * 13 % n) for i in range(150)]
    pairs = spark.createDataFrame(rows, "pair_id long, src long, dst long")
    want = {i: b in after[a] for i, a, b in rows}
    monkeypatch.setattr(paths, "PAIRS", 100)
    assert R.column(paths.reachable(g, pairs, method).withColumnRenamed("pair_id", "id"), "reachable") == want
    monkeypatch.setattr(paths, "SMALL_ARCS", 0)
    assert R.column(paths.reachable(g, pairs, method).withColumnRenamed("pair_id", "id"), "reachable") == want


def test_pairs_cost_bits_not_rows(spark, path):
    pairs = spark.range(64).selectExpr("id pair_id", "id src", "300 - id dst")
    assert jobs_of(spark, lambda: paths.reachable(path, pairs, "bfs")) < 80


def test_components_of_long_paths_take_few_jobs(spark, path):
    for method in ("hook", "bfs"):
        assert jobs_of(spark, lambda: components.connected_components(path, method)) < 30
        assert set(R.column(components.connected_components(path, method), "component").values()) == {0}


def test_components_in_parts_agree(spark, monkeypatch):
    """Stars of many tasks, labels of many blocks, and rounds over all arcs."""
    n, arcs = 80, R.random_arcs(3, 80, 75)
    g, want = R.graph(spark, arcs, n).stored(), R.components(80, arcs)
    monkeypatch.setattr(components, "STAR_ROWS", 5)
    monkeypatch.setattr(loop, "WHOLE_ROWS", 0)
    assert R.column(components.connected_components(g), "component") == want
    assert R.column(components.connected_components(g, "bfs"), "component") == want
    monkeypatch.setattr(components, "MOST_ROWS", 0)
    assert R.column(components.connected_components(g), "component") == want


def test_strong_components_of_chains_take_few_jobs(spark, path):
    """A chain of small cycles, which no trim shortens."""
    arcs = [a for i in range(0, 90, 3) for a in ((i, i + 1, 1), (i + 1, i + 2, 1), (i + 2, i, 1), (i + 2, i + 3, 1))]
    g = R.graph(spark, arcs, 91).stored()
    assert jobs_of(spark, lambda: scc.strong_components(g)) < 20
    assert R.column(scc.strong_components(g), "component") == R.strong(91, arcs)


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_and_colours_in_parts_agree(spark, monkeypatch, seed):
    n, arcs = 60, R.random_arcs(seed + 20, 60, 110)
    g = R.graph(spark, arcs, n).stored()
    for limit in (1 << 20, 4):
        monkeypatch.setattr(scc, "TASK_ARCS", limit)
        monkeypatch.setattr(colouring, "TASK_ARCS", limit)
        assert R.column(scc.strong_components(g), "component") == R.strong(n, arcs)
        assert R.column(colouring.colour(g), "colour") == R.greedy_colours(n, arcs)
        monkeypatch.setattr(loop, "WHOLE_ROWS", 0)


def test_colours_of_a_path_take_few_jobs(spark, path):
    assert jobs_of(spark, lambda: colouring.colour(path)) < 12


def test_flow_hops_are_no_jobs(spark, path):
    assert jobs_of(spark, lambda: flow.max_flow(path, 0, 200)[1]) < 80
    assert flow.max_flow(path, 0, 200)[0] == 1


def test_flow_in_blocks_is_the_same(spark, monkeypatch):
    """The same paths are found, so the same arcs have flow."""
    arcs = R.random_arcs(31, 25, 70)
    g = R.graph(spark, arcs, 25).stored()
    value, flows = flow.max_flow(g, 0, 24)
    assert value == R.edmonds_karp(25, arcs, 0, 24)
    monkeypatch.setattr(flow, "BLOCK_ARCS", 0)
    other, others = flow.max_flow(g, 0, 24)
    assert other == value and sorted(map(tuple, others.collect())) == sorted(map(tuple, flows.collect()))
