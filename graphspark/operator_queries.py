"""Queries of single operators (sources, transforms, frontiers, comparisons, tables of results), each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.functions import metrics, rating, verify
from graphspark.functions.text import without_prefix
from graphspark.graph import Graph
from graphspark.operators import primitives, transforms
from graphspark.oracles import DEG, RESULTS, X, over
from graphspark.plans.tables import new_path
from graphspark.queries import dense, results, sparse, state_of
from graphspark.sources import generators, store, text

i = F.col
#: Of the generated graphs.
SCALE, ARCS, SEED = 10, 8192, 1


def one(spark, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


# --- generators ---------------------------------------------------------------------------------------------------


def unit(*parts: str) -> str:
    """SQL of generators.uniform01."""
    return f"(('0x' || substr(md5({' || chr(47) || '.join(parts)}), 1, 13))::BIGINT / {1 << 52}::DOUBLE)"


def rmat_sql(arcs: int = ARCS, scale: int = SCALE, seed: int = SEED) -> str:
    a, b, c, _ = generators.QUADRANTS
    u = lambda k: f"(('0x' || substr(d{k // 8}, {1 + 4 * (k % 8)}, 4))::BIGINT / 65536.0::DOUBLE)"
    down = " + ".join(f"CASE WHEN {u(k)} >= {a + b}::DOUBLE / 100 THEN {1 << k} ELSE 0 END" for k in range(scale))
    right = " + ".join(f"CASE WHEN ({u(k)} >= {a}::DOUBLE / 100 AND {u(k)} < {a + b}::DOUBLE / 100) OR {u(k)} >= {a + b + c}::DOUBLE / 100 THEN {1 << k} ELSE 0 END" for k in range(scale))
    digests = ", ".join(f"md5(id::VARCHAR || '/{seed}/{k}') AS d{k}" for k in range(-(-scale // 8)))
    return f"d AS (SELECT {digests} FROM range({arcs}) t(id)), g AS (SELECT ({down})::BIGINT AS src, ({right})::BIGINT AS dst FROM d)"


UNIFORM = f"g AS (SELECT floor({unit('id::VARCHAR', repr(str(SEED)), repr('src'))} * 1024)::BIGINT AS src, floor({unit('id::VARCHAR', repr(str(SEED)), repr('dst'))} * 1024)::BIGINT AS dst FROM range({ARCS}) t(id))"
HISTOGRAM = "SELECT CASE WHEN degree = 0 THEN -1 ELSE floor(log2(degree)) END::BIGINT AS bucket, count(*) AS vertices FROM (SELECT id, count(src) AS degree FROM range(1024) t(id) LEFT JOIN g ON src = id GROUP BY id) GROUP BY 1"
BLOCKS = f"""WITH b AS (SELECT id, id // 10 * 10 AS a FROM range(300) t(id)), s AS (SELECT *, least(10, 300 - a) AS n FROM b),
  g AS (SELECT id AS src, a + (id - a + 1) % n AS dst FROM s UNION ALL SELECT id, a + floor({unit('id::VARCHAR', "'1'", "'1'")} * n)::BIGINT FROM s
    UNION ALL SELECT id, a + 10 + floor({unit('id::VARCHAR', "'1'", "'2'")} * greatest(300 - a - 10, 0))::BIGINT FROM s)
  SELECT src, dst FROM g WHERE dst < 300"""
KRONECKER = f"WITH {rmat_sql(4 << 6, 6)}, m AS (SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR || '/1'), id) - 1 AS new_id FROM range(64) t(id)) SELECT a.new_id AS src, b.new_id AS dst, round({unit('src::VARCHAR', 'dst::VARCHAR', repr('1'), repr('99'))}, 10) AS weight FROM g JOIN m a ON a.id = src JOIN m b ON b.id = dst"


def edges_of(g: Graph) -> DataFrame:
    return g.edges.select("src", "dst")


def kronecker(s, d):
    return generators.kronecker(s, 6, 4, seed=1).edges.select("src", "dst", F.round("weight", 10).alias("weight"))


# --- files ----------------------------------------------------------------------------------------------------------


def text_import(s, d):
    path = new_path(s, "edge-list")
    text.write_edge_list(sparse(s, d), path)
    return edges_of(text.read_edge_list(s, path))


def stored_graph(s, d):
    path = new_path(s, "graph")
    store.save(sparse(s, d), path, sorted_by_source=True)
    return store.prepare(s, "load", path).edges.select("src", "dst", "weight")


def container(s, d):
    path = f"{new_path(s, 'edges').removeprefix('file://')}.el_container"
    store.write_container(sparse(s, d), path)
    return edges_of(store.prepare(s, "import", path))


def weighted_lines(s, d):
    return text.edge_list_lines(sparse(s, d), "weight", header=True)


def dot(s, d):
    return text.dot_rows(sparse(s, d)).select("value")


def flow_dot(s, d):
    flows = sparse(s, d).edges.select("src", "dst", i("weight").alias("capacity"), (i("weight") / 4).alias("flow"))
    return text.dot_rows(sparse(s, d), flows).select("value")


def exported(s, d):
    path = new_path(s, "results")
    rating.write_results(results(s, d), path)
    return s.read.option("header", True).schema("app_name string, graph_name string, arch_name string, perf_val double").csv(path)


# --- transforms -------------------------------------------------------------------------------------------------------


def sorted_arcs(s, d):
    """How many arcs there are, how many stand before a smaller one, and how many sources lie in several partitions."""
    from pyspark.sql import Window

    rows = transforms.sort_by_source(dense(s, d)).edges.select("src", "dst", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    w = Window.partitionBy("p").orderBy("at")
    rows = rows.withColumn("late", F.coalesce(F.lag(F.struct("src", "dst")).over(w) > F.struct("src", "dst"), F.lit(False)))
    split = rows.groupBy("src").agg(F.countDistinct("p").alias("n"), F.count_if("late").alias("late"), F.count(F.lit(1)).alias("arcs"))
    return split.agg(F.sum("arcs").alias("arcs"), F.sum("late").alias("out_of_order"), F.count_if(i("n") > 1).alias("split_sources"))


def positions(s, d):
    return s.read.parquet(f"{d}/part.parquet").select(i("p_partkey").alias("position"), F.pmod(i("p_partkey") * 7919, F.lit(101)).alias("k"))


def permuted(s, d):
    rows = positions(s, d)
    n = rows.count()
    # Whether ids start at 0 or 1, the last position's source is the first.
    low = rows.agg(F.min("position")).first()[0]
    return transforms.permute(rows.withColumnRenamed("k", "value"), rows.select("position", (F.pmod(i("position") - low + 1, F.lit(n)) + low).alias("source")))


POSITIONS = "p AS (SELECT p_partkey AS position, (p_partkey * 7919) % 101 AS k FROM part)"


def shuffled(s, d):
    return transforms.shuffle_labels(sparse(s, d), 3).degrees().select("id", "degree")


# --- frontiers, properties ----------------------------------------------------------------------------------------------


def frontier_changes(s, d):
    g = sparse(s, d)
    some = primitives.new_frontier(state_of(g), i("x") < 100)
    grown = primitives.add_to_frontier(primitives.add_to_frontier(some, primitives.frontier_of(g, 1, 2, 3)), some)
    return grown.withColumn("among_all", F.lit(True)).join(primitives.all_active(g), "id", "right").select("id", F.coalesce("among_all", F.lit(False)).alias("active"))


def packed(s, d):
    state = state_of(sparse(s, d)).withColumn("y", i("id") % 3)
    return primitives.unpack(primitives.pack(state, "x", "y")).select("id", "x", "y")


def edge_values(s, d):
    g = primitives.edge_compute(sparse(s, d), double=i("weight") * 2, gap=F.abs(i("src") - i("dst")))
    return g.edges.select("src", "dst", "double", "gap")


def reduction(agg: str, kind: str):
    def run(s, d):
        g = dense(s, d)
        return one(s, f"value {kind}", primitives.reduce(g.degrees(), i("degree"), agg))

    return run


def reduced_frontier(s, d):
    g = dense(s, d)
    return one(s, "value long", primitives.reduce(g.degrees(), i("degree"), "sum", primitives.new_frontier(state_of(g), i("x") < 500)))


# --- comparisons, figures ---------------------------------------------------------------------------------------------


def degree_mismatches(s, d):
    g = sparse(s, d)
    return verify.mismatches(g.degrees("out"), g.degrees("in"), "degree", tolerance=1)


def partitions(s, d):
    ids = dense(s, d).vertices
    label = lambda n, k: ids.select("id", (F.pmod(i("id"), F.lit(n)) * k).alias("component"))
    return one(s, "renamed boolean, finer boolean", verify.equal_partitions(label(7, 1), label(7, 10)), verify.equal_partitions(label(7, 1), label(14, 1)))


PARTITIONS = """WITH k AS (SELECT p_partkey % 7 AS a, (p_partkey % 7) * 10 AS b, p_partkey % 14 AS c FROM part)
  SELECT count(DISTINCT (a, b)) = count(DISTINCT a) AND count(DISTINCT (a, b)) = count(DISTINCT b) AS renamed, count(DISTINCT (a, c)) = count(DISTINCT a) AND count(DISTINCT (a, c)) = count(DISTINCT c) AS finer FROM k"""


def rankings(s, d):
    ranks = state_of(dense(s, d)).select("id", ((i("x") + 1) / 1e9).alias("rank"))
    return one(s, "same boolean, off boolean", verify.equal_rankings(ranks, ranks), verify.equal_rankings(ranks, ranks.withColumn("rank", i("rank") * 1.01)))


RANKINGS = over(1, X + ", r AS (SELECT (x + 1) / 1e9::DOUBLE AS a, (x + 1) / 1e9::DOUBLE * 1.01::DOUBLE AS b FROM s) SELECT max(abs(a - a) / a) <= 1e-9 AS same, max(abs(a - b) / greatest(a, b)) <= 1e-9 AS off FROM r")


def figures(s, d):
    """Rounds over each ship mode's lines as edges, in as many seconds as a price says."""
    stats = metrics.PerformanceStats()
    for r in s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")).collect():
        stats.rounds.append((r["n"] * 10, r["l_linenumber"] / 4))
    found = stats.report()
    return one(s, "low double, middle double, high double, ten double", *(round(found[f"{k}_mteps"], 9) for k in ("min", "avg", "max")), round(metrics.mteps(3_000_000, 1.5, 10), 9))


FIGURES = "WITH r AS (SELECT count(*) * 10 / (l_linenumber / 4.0::DOUBLE * 1e6) AS m FROM lineitem GROUP BY l_linenumber) SELECT round(min(m), 9) AS low, round(avg(m), 9) AS middle, round(max(m), 9) AS high, 20.0::DOUBLE AS ten FROM r"


# --- tables of results ---------------------------------------------------------------------------------------------------


def inserted(s, d):
    r = results(s, d)
    return rating.insert_many(r, r.where("app_name = 'A'").drop("perf_val")).groupBy("app_name").agg(F.count(F.lit(1)).alias("rows"), F.count("perf_val").alias("with_value"))


def one_found(s, d):
    return rating.find_one(results(s, d), {"app_name": "A", "graph_name": "1", "arch_name": "arch3"})


def counted(s, d):
    r = results(s, d)
    return one(s, "every long, some long", rating.count_documents(r), rating.count_documents(r, {"app_name": "R"}))


def labelled(s, d):
    return s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", without_prefix(i("n_name"), "UNITED").alias("name"))


PAIRS = {
    "rmat_edges": (lambda s, d: edges_of(generators.rmat(s, SCALE, ARCS, seed=SEED)), f"WITH {rmat_sql()} SELECT src, dst FROM g"),
    "rmat_undirected": (lambda s, d: edges_of(generators.rmat(s, SCALE, ARCS, directed=False, seed=SEED)), f"WITH {rmat_sql()} SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g"),
    "uniform_edges": (lambda s, d: edges_of(generators.uniform(s, 1024, ARCS, seed=SEED)), f"WITH {UNIFORM} SELECT src, dst FROM g"),
    "block_edges": (lambda s, d: edges_of(generators.strong_blocks(s, 300, 10, seed=1)), BLOCKS),
    "kronecker_edges": (kronecker, KRONECKER),
    "text_import": (text_import, over(2, ", z AS (SELECT CASE WHEN min(least(src, dst)) = 0 THEN 1 ELSE 0 END AS z FROM e) SELECT src + z AS src, dst + z AS dst FROM e, z")),
    "stored_graph": (stored_graph, over(2, " SELECT src, dst, weight FROM e")),
    "container_import": (container, over(2, " SELECT src, dst FROM e")),
    "weighted_lines": (weighted_lines, over(2, ", z AS (SELECT CASE WHEN min(least(src, dst)) = 0 THEN 1 ELSE 0 END AS z FROM e), n AS (SELECT count(*) + (SELECT z FROM z) AS n FROM v) SELECT n || ' ' || n || ' ' || (SELECT count(*) FROM e) AS value FROM n UNION ALL SELECT (src + z)::VARCHAR || ' ' || (dst + z)::VARCHAR || ' ' || weight::DOUBLE::VARCHAR FROM e, z")),
    "dot_lines": (dot, over(2, " SELECT src || ' -> ' || dst || ';' AS value FROM e")),
    "flow_dot_lines": (flow_dot, over(2, """ SELECT src || ' -> ' || dst || ' [label = " ' || regexp_replace(printf('%.6f', weight / 4), '[.]?0+$', '') || '/' || regexp_replace(printf('%.6f', weight::DOUBLE), '[.]?0+$', '') || ' "];' AS value FROM e""")),
    "results_export": (exported, f"WITH {RESULTS} SELECT * FROM r"),
    "sorted_arcs": (sorted_arcs, over(1, " SELECT count(*) AS arcs, 0::BIGINT AS out_of_order, count(DISTINCT src) - count(DISTINCT src) AS split_sources FROM e")),
    "shards": (lambda s, d: transforms.shards(dense(s, d), 100).groupBy("shard").agg(F.count(F.lit(1)).alias("arcs")), over(1, " SELECT dst // 100 AS shard, count(*) AS arcs FROM e GROUP BY 1")),
    "shuffled_labels": (shuffled, over(2, DEG + " SELECT row_number() OVER (ORDER BY md5(id::VARCHAR || '/3'), id) - 1 AS id, degree FROM deg")),
    "random_vertex": (lambda s, d: one(s, "id long", transforms.random_vertex(sparse(s, d), 5)), over(2, " SELECT src AS id FROM (SELECT DISTINCT src FROM e) ORDER BY md5(src::VARCHAR || '/5'), src LIMIT 1")),
    "sorted_positions": (lambda s, d: transforms.sort_with_positions(positions(s, d), "k", True).limit(100), f"WITH {POSITIONS} SELECT * FROM p ORDER BY k DESC, position LIMIT 100"),
    "copied": (lambda s, d: transforms.copy_if(positions(s, d), i("k") > 50), f"WITH {POSITIONS} SELECT * FROM p WHERE k > 50"),
    "counted_if": (lambda s, d: one(s, "n long", transforms.count_if(positions(s, d), i("k") > 50)), f"WITH {POSITIONS} SELECT count(*) AS n FROM p WHERE k > 50"),
    "arcs_of_vertices": (lambda s, d: one(s, "n long", transforms.count_with_arcs(sparse(s, d))), over(2, " SELECT count(DISTINCT src) AS n FROM e")),
    "permuted": (permuted, f"WITH {POSITIONS}, n AS (SELECT count(*) AS n, min(position) AS low FROM p) SELECT a.position, b.k AS value FROM p a, n JOIN p b ON b.position = (a.position - low + 1) % n + low"),
    "random_values": (lambda s, d: transforms.random_values(positions(s, d).select("position"), "value", 1000, 9, whole=True), f"WITH {POSITIONS} SELECT position, floor({unit('position::VARCHAR', repr('9'))} * 1000)::BIGINT AS value FROM p"),
    "frontier_changes": (frontier_changes, over(2, X + " SELECT id, x < 100 OR id IN (1, 2, 3) AS active FROM s")),
    "packed_values": (packed, over(2, X + " SELECT id, x, id % 3 AS y FROM s")),
    "edge_values": (edge_values, over(2, ' SELECT src, dst, weight * 2 AS "double", abs(src - dst) AS gap FROM e')),
    "reduce_sum": (reduction("sum", "long"), over(1, DEG + " SELECT sum(degree)::BIGINT AS value FROM deg")),
    "reduce_min": (reduction("min", "long"), over(1, DEG + " SELECT min(degree) AS value FROM deg")),
    "reduce_max": (reduction("max", "long"), over(1, DEG + " SELECT max(degree) AS value FROM deg")),
    "reduce_avg": (reduction("avg", "double"), over(1, DEG + " SELECT avg(degree) AS value FROM deg")),
    "reduce_frontier": (reduced_frontier, over(1, X + " SELECT count(*) AS value FROM e JOIN s ON s.id = src WHERE x < 500")),
    "degree_mismatches": (degree_mismatches, over(2, ", o AS (SELECT id, count(src) AS a FROM v LEFT JOIN e ON src = id GROUP BY id), n AS (SELECT id, count(dst) AS b FROM v LEFT JOIN e ON dst = id GROUP BY id) SELECT id, a, b FROM o JOIN n USING (id) WHERE abs(a - b) > 1")),
    "equal_partitions": (partitions, PARTITIONS),
    "equal_rankings": (rankings, RANKINGS),
    "performance_figures": (figures, FIGURES),
    "perf_insert": (inserted, f"WITH {RESULTS}, b AS (SELECT app_name, perf_val FROM r UNION ALL SELECT app_name, NULL FROM r WHERE app_name = 'A') SELECT app_name, count(*) AS rows, count(perf_val) AS with_value FROM b GROUP BY 1"),
    "perf_find_one": (one_found, f"WITH {RESULTS} SELECT * FROM r WHERE app_name = 'A' AND graph_name = '1' AND arch_name = 'arch3'"),
    "perf_count": (counted, f"WITH {RESULTS} SELECT count(*) AS every, count(*) FILTER (WHERE app_name = 'R') AS some FROM r"),
    "label_without_prefix": (labelled, "SELECT n_nationkey, CASE WHEN starts_with(n_name, 'UNITED') THEN trim(substr(n_name, 7)) ELSE n_name END AS name FROM nation"),
}
QUERIES = {k: q for k, (q, _) in PAIRS.items()}
ORACLES = {k: sql for k, (_, sql) in PAIRS.items()} | {"rmat_degree_stats": f"WITH {rmat_sql()} {HISTOGRAM}", "uniform_degree_stats": f"WITH {UNIFORM} {HISTOGRAM}"}
