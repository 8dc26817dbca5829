import os

import duckdb
import pytest

from graphspark import operator_queries, oracles, queries

DATA = "/root/testdata/sf0.001"
LIGHT = ["edge_build_g2", "out_degree", "degree_report", "degree_histogram", "hub_share", "csr_offsets", "ligra_lines", "scatter_min", "gather_sum", "exchange_max", "bfs_levels", "pagerank", "cc_labels", "tc_pairs", "perf_rating_sliders", "perf_table", "category_enrich", "page_extract", "log_extract"]


QUERIES, ORACLES = queries.QUERIES | operator_queries.QUERIES, oracles.ORACLES | operator_queries.ORACLES
LIGHT += ["sssp_pull", "label_prop_recent", "random_walk", "rmat_degree_stats", *operator_queries.QUERIES]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", LIGHT)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(repr, result.fetchall()))
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == want
