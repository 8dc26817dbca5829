"""Degree and component analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators.components import component_sizes
from graphspark.operators.transforms import degree_groups


def degree_histogram(g: Graph, direction: str = "out") -> DataFrame:
    """bucket, vertices: by the whole logarithm of the degree; -1 for no arcs."""
    bucket = F.when(F.col("degree") == 0, -1).otherwise(F.floor(F.log2(F.col("degree").cast("double")))).cast("long")
    return g.degrees(direction).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("vertices"))


def degree_report(g: Graph, direction: str = "out") -> DataFrame:
    """One row: vertices, edges, whole average degree, highest degree with its share of the edges in percent, whole percent of vertices without arcs."""
    row = g.degrees(direction).agg(F.count(F.lit(1)).alias("vertices"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"), F.coalesce(F.max("degree"), F.lit(0)).alias("highest"), F.count_if(F.col("degree") == 0).alias("zero"))
    return row.select(
        "vertices", "edges", F.expr("CASE WHEN vertices > 0 THEN edges div vertices END").alias("average_degree"), "highest",
        F.when(F.col("edges") > 0, F.round(100.0 * F.col("highest") / F.col("edges"), 6)).alias("highest_percent"), F.expr("CASE WHEN vertices > 0 THEN zero * 100 div vertices END").alias("zero_percent"),
    )


def hub_share(g: Graph, top_percent: int = 1) -> DataFrame:
    """share of the arcs that leave the vertices of most arcs, one in 100 (at least one): found from the counts of each degree, of
    which there are far fewer than vertices."""
    from pyspark.sql import Window

    counts = g.degrees().groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("degree").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = counts.agg(F.sum("n").alias("v"), F.sum(F.col("n") * F.col("degree")).alias("e")).first()
    v, e = total["v"] or 0, total["e"] or 0
    room = max(1, v * top_percent // 100)
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(room) - F.col("before")))
    return counts.withColumn("before", before).agg(F.round(F.sum(taken * F.col("degree")) / F.lit(max(e, 1)), 6).alias("share"))


def degree_regions(g: Graph, direction: str = "out") -> DataFrame:
    """bucket, vertices, edges, percent of all edges, for the degree groups."""
    e = max(1, g.edges.count())
    return degree_groups(g, direction).groupBy("bucket").agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("edges")).withColumn("percent", F.round(100.0 * F.col("edges") / e, 6))


def component_report(components: DataFrame) -> DataFrame:
    """One row: components, the size of the largest, and how many have more than one vertex."""
    return component_sizes(components).agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"), F.count_if(F.col("size") > 1).alias("non_trivial"))


def sparsity_matrix(g: Graph, side: int = 256) -> DataFrame:
    """row, col, share: of the arcs, those between two segments of ids, (V - 1) / side + 1 ids each; without empty cells."""
    v, e = g.vertices.count(), max(1, g.edges.count())
    segment = max(0, v - 1) // side + 1
    at = lambda c: F.expr(f"{c} div {segment}").alias
    return g.edges.groupBy(at("src")("row"), at("dst")("col")).agg((F.count(F.lit(1)) / F.lit(float(e))).alias("share"))


def sparsity_features(g: Graph) -> DataFrame:
    """One row with the scalars that go with the matrix: V / 2**26, and the whole average degree."""
    v = g.vertices.count()
    return g.edges.agg((F.lit(v) / float(1 << 26)).alias("size"), F.expr(f"count(*) div {max(1, v)}").alias("average_degree"))


def best_format(results: DataFrame) -> DataFrame:
    """graph_name, format: the one of the highest perf_val, ties to the first name."""
    return results.groupBy("graph_name").agg(F.min_by("format", F.struct((-F.col("perf_val")).alias("p"), "format")).alias("format"))


def work_balance(g: Graph) -> DataFrame:
    """One row: arcs of a partition at least, on average and at most, and the largest's percent over the average."""
    counts = g.edges.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min("n").alias("least"), F.avg("n").alias("average"), F.max("n").alias("most"), (100.0 * (F.max("n") / F.avg("n") - 1)).alias("over_percent"))


def size_in_bytes(g: Graph) -> int:
    """The optimizer's estimate for both tables."""
    return sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (g.vertices, g.edges))
