"""python -m graphspark.cli: generate, convert and query graphs.

Examples:
  convert -gen -rmat -s 16 -e 32 -o graph
  run bfs -load graph -check
  run pr -import edges.txt -it 10
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphspark.functions import verify
from graphspark.functions.metrics import PerformanceStats
from graphspark.graph import Graph
from graphspark.operators import colouring, components, flow, labels, paths, ranking, scc, walks
from graphspark.operators.transforms import random_vertex, symmetrize
from graphspark.sources import generators, store, text

APPS = ("bfs", "sssp", "sswp", "pr", "hits", "cc", "scc", "coloring", "tc", "mf", "rw", "lp")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("convert", "run"))
    p.add_argument("app", nargs="?", choices=APPS)
    source = p.add_mutually_exclusive_group()
    source.add_argument("-load", metavar="PATH", help="a stored graph")
    source.add_argument("-import", dest="import_", metavar="PATH", help="an edge list or .el_container")
    source.add_argument("-gen", action="store_true", help="a synthetic graph (default)")
    p.add_argument("-s", type=int, default=10, help="log2 of the vertices")
    p.add_argument("-e", type=int, default=5, help="edges for each vertex")
    p.add_argument("-rmat", dest="type", action="store_const", const="rmat", default="rmat")
    p.add_argument("-ru", dest="type", action="store_const", const="uniform")
    p.add_argument("-type", dest="type", choices=("rmat", "uniform"))
    p.add_argument("-directed", dest="directed", action="store_true", default=True)
    p.add_argument("-undirected", dest="directed", action="store_false")
    p.add_argument("-format", choices=("parquet", "el_container", "text", "mtx", "ligra"), default="parquet")
    p.add_argument("-o", metavar="PATH", default="graph")
    p.add_argument("-it", type=int, default=1, help="rounds, which are averaged, each from another vertex; iterations of pr, hits and lp; pairs of tc; steps of rw")
    p.add_argument("-check", action="store_true", help="compare with another method, or with what a result has to fulfil")
    p.add_argument("-all-active", dest="mode", action="store_const", const="all", default="delta")
    p.add_argument("-partial-active", dest="mode", action="store_const", const="delta")
    p.add_argument("-push", dest="direction", action="store_const", const="push", default="push")
    p.add_argument("-pull", dest="direction", action="store_const", const="pull")
    p.add_argument("-td", dest="strategy", action="store_const", const="push", default="push")
    p.add_argument("-bu", dest="strategy", action="store_const", const="pull")
    p.add_argument("-do", dest="strategy", action="store_const", const="auto")
    p.add_argument("-sv", dest="method", action="store_const", const="hook")
    p.add_argument("-bfs-based", dest="method", action="store_const", const="bfs")
    p.add_argument("-purdoms", dest="method", action="store_const", const="condensed")
    p.add_argument("-wv", type=float, default=20.0, help="percent of the vertices that walks start at")
    p.add_argument("-store-walk-paths", action="store_true")
    p.add_argument("-seed", type=int, default=0)
    return p


def graph_of(spark: SparkSession, a: argparse.Namespace) -> Graph:
    if a.load:
        return store.load(spark, a.load)
    if a.import_:
        return store.prepare(spark, "import", a.import_) if a.import_.endswith(".el_container") else text.read_edge_list(spark, a.import_, a.directed)
    v = 1 << a.s
    g = generators.rmat(spark, a.s, a.e * v, directed=a.directed, seed=a.seed, shuffle=True) if a.type == "rmat" else generators.uniform(spark, v, a.e * v, a.directed, a.seed)
    return Graph(g.vertices, g.edges.withColumn("weight", F.pmod(F.xxhash64("src", "dst"), F.lit(100)).cast("double") + 1))


def convert(g: Graph, a: argparse.Namespace) -> None:
    if a.format == "parquet":
        store.save(g, a.o)
    elif a.format == "el_container":
        store.write_container(g, a.o)
    elif a.format == "ligra":
        text.write_ligra(g, a.o)
    else:
        text.write_edge_list(g, a.o, header=a.format == "mtx")


def same_values(column: str, tolerance: float = 0.0):
    """Counts the vertices of two results that differ."""
    return lambda x, y: verify.mismatches(x, y, column, tolerance, relative=tolerance > 0).count()


def same_partition(x, y, label: str = "component") -> int:
    return 0 if verify.equal_partitions(x, y, label) else 1


def run(g: Graph, a: argparse.Namespace, round_: int = 0):
    """The result, and a function that checks it: against another method, or by what it has to fulfil. It returns a number of errors."""
    against = lambda other, errors: lambda result: errors(result, other())
    first = lambda k=0: random_vertex(g, a.seed + 2 * round_ + k)
    if a.app == "bfs":
        s = first()
        return paths.bfs(g, s, strategy=a.strategy), against(lambda: paths.bfs(g, s, strategy="pull" if a.strategy == "push" else "push"), same_values("level"))
    if a.app in ("sssp", "sswp"):
        s, f = first(), getattr(paths, a.app)
        return f(g, s, mode=a.mode, direction=a.direction), against(lambda: f(g, s, mode="all", direction="pull" if a.direction == "push" else "push"), same_values("distance" if a.app == "sssp" else "width", 1e-9))
    if a.app == "pr":
        # Ranks along the arcs are those of the reversed graph against them.
        return ranking.page_rank(g, a.it), against(lambda: ranking.page_rank(g.reverse(), a.it, "transpose"), same_values("rank", 1e-9))
    if a.app == "hits":
        swapped = lambda: ranking.hits(g, a.it).select("id", F.round("authority", 9).alias("authority"))
        return ranking.hits(g, a.it).withColumn("authority", F.round("authority", 9)), against(swapped, same_values("authority", 1e-6))
    if a.app == "cc":
        method = a.method or "hook"
        return components.connected_components(g, method), against(lambda: components.connected_components(g, "bfs" if method == "hook" else "hook"), same_partition)
    if a.app == "scc":
        return scc.strong_components(g), against(lambda: scc.strong_components(g.reverse()), same_partition)
    if a.app == "coloring":
        both = symmetrize(g)
        return colouring.colour(both), lambda result: verify.colour_conflicts(both, result).count()
    if a.app == "lp":
        return labels.label_propagation(g, a.it), against(lambda: labels.label_propagation(Graph(g.vertices, g.edges.repartition("dst")), a.it), same_values("label"))
    v = g.vertices.count()
    if a.app == "tc":
        end = lambda k: F.floor(generators.uniform01(F.col("id"), a.seed, k) * v).cast("long")
        pairs = g.spark.range(a.it).select(F.col("id").alias("pair_id"), end("src").alias("src"), end("dst").alias("dst"))
        method = a.method or "condensed"
        named = lambda m: paths.reachable(g, pairs, m).select(F.col("pair_id").alias("id"), F.col("reachable").cast("int").alias("reachable"))
        return named(method), against(lambda: named("bfs" if method == "condensed" else "condensed"), same_values("reachable"))
    if a.app == "rw":
        starts = g.vertices.where(generators.uniform01(F.col("id"), a.seed) * 100 < a.wv).select(F.col("id").alias("walk"), "id")
        # Each step of a walk has to be an arc.
        steps = lambda: walks.random_walk(g, starts, a.it, a.seed, True).select(F.explode(F.expr("transform(sequence(1, greatest(size(path) - 1, 1)), k -> struct(get(path, k - 1) AS src, get(path, k) AS dst))")).alias("s")).select("s.*").where("dst is not null")
        return walks.random_walk(g, starts, a.it, a.seed, a.store_walk_paths), lambda result: steps().join(g.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").count()
    source, sink = first(), first(1)
    value, flows = flow.max_flow(g, source, sink)
    print(f"flow: {value:g}")

    def errors(result) -> int:
        """Vertices that don't pass on what they get, but for both ends, arcs over their capacity, and a wrong value."""
        moves = result.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("flow").alias("x")), F.struct(F.col("dst").alias("id"), (-F.col("flow")).alias("x")))).alias("m")).select("m.*")
        sums = moves.groupBy("id").agg(F.sum("x").alias("x")).withColumn("want", F.when(F.col("id") == source, value).when(F.col("id") == sink, -value).otherwise(0.0))
        return sums.where(F.abs(F.col("x") - F.col("want")) > 1e-6).count() + result.where("flow > capacity + 1e-9").count()

    return flows, errors


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphspark").getOrCreate()
    g = graph_of(spark, a).stored()
    if a.command == "convert":
        convert(g, a)
        return 0
    if not a.app:
        parser().error("run needs an app")
    stats, edges = PerformanceStats(), g.edges.count()
    fixed = a.app in ("pr", "hits", "lp", "tc", "rw")
    found = 0
    for k in range(1 if fixed else a.it):
        with stats.round(edges, a.it if a.app in ("pr", "hits") else 1):
            result, errors = run(g, a, k)
            rows = result.count()
        if a.check:
            found += errors(result)
    print(f"{rows} rows\nAVG_PERF: {stats.report()['avg_mteps']:.6f} MTEPS")
    if a.check:
        print(f"error count: {found}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
