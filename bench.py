"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphspark.functions import analytics
from graphspark.functions.metrics import mteps
from graphspark.operators import colouring, components, flow, labels, paths, ranking, scc, walks
from graphspark.operators.transforms import symmetrize
from graphspark.sources.generators import co_purchase

ITERATIONS = 10


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    g = co_purchase(spark, sf_dir, "dense").stored()
    forest = co_purchase(spark, sf_dir, "forest").stored()
    edges, vertices = g.edges.count(), g.vertices.count()
    source = g.edges.agg(F.min("src")).first()[0]
    both = symmetrize(g).stored()
    pairs = spark.range(500).select(F.col("id").alias("pair_id"), F.pmod(F.col("id") * 7919, F.lit(vertices)).alias("src"), F.pmod(F.col("id") * 104729 + 1, F.lit(vertices)).alias("dst"))
    starts = g.vertices.where(F.pmod(F.col("id"), F.lit(5)) == 0).select(F.col("id").alias("walk"), "id")
    ends = [r[0] for r in forest.edges.where("src <> dst").groupBy("src").count().orderBy(F.desc("count"), "src").limit(2).collect()]
    runs = {
        "bfs": lambda: paths.bfs(g, source), "sssp_push": lambda: paths.sssp(g, source), "sssp_pull": lambda: paths.sssp(g, source, direction="pull"), "sswp": lambda: paths.sswp(g, source),
        "pagerank": lambda: ranking.page_rank(g, ITERATIONS), "hits": lambda: ranking.hits(g, ITERATIONS), "cc_sv": lambda: components.connected_components(g), "cc_bfs": lambda: components.connected_components(g, "bfs"),
        "scc": lambda: scc.strong_components(g), "coloring": lambda: colouring.colour(forest), "tc_purdoms": lambda: paths.reachable(g, pairs), "label_prop": lambda: labels.label_propagation(both, 5),
        "random_walk": lambda: walks.random_walk(g, starts, ITERATIONS), "max_flow": lambda: flow.max_flow(forest, ends[0], ends[1])[1],
        "degree_histogram": lambda: analytics.degree_histogram(g), "sparsity_matrix": lambda: analytics.sparsity_matrix(g),
    }
    took = {}
    for name, run in runs.items():
        if only and name not in only:
            continue
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    own = {"coloring": forest.edges.count(), "max_flow": forest.edges.count(), "label_prop": both.edges.count()}
    rates = {n: round(mteps(own.get(n, edges), s, ITERATIONS if n in ("pagerank", "hits") else 1), 4) for n, s in took.items()}
    print(json.dumps({"metric": "graph queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "mteps": rates, "vertices": vertices, "edges": edges, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
