"""Transforms of the edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.plans.tables import materialize


def transpose(g: Graph) -> Graph:
    return g.reverse()


def symmetrize(g: Graph) -> Graph:
    """Adds the reverse of every arc; what repeats is kept."""
    return Graph(g.vertices, g.directed("both"))


def relabel(g: Graph, mapping: DataFrame) -> Graph:
    """Renames vertices by mapping(id, new_id)."""
    by = lambda end: mapping.select(F.col("id").alias(end), F.col("new_id").alias(f"new_{end}"))
    edges = g.edges.join(by("src"), "src").join(by("dst"), "dst").drop("src", "dst").withColumnsRenamed({"new_src": "src", "new_dst": "dst"})
    return Graph(g.vertices.join(mapping, "id").drop("id").withColumnRenamed("new_id", "id"), edges)


def dense_rank_ids(rows: DataFrame, *order: Column) -> DataFrame:
    """id, new_id: 0, 1, ... in the given order, without a window over all rows: each range partition numbers its own
    rows, and starts where the one before it ends. What is broadcast is one number for each partition."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    # Written, not cached: ranges are sampled, so what is lost must not be computed again.
    parts, _ = materialize(parts.select("id", "p", (F.col("m") - F.shiftleft(F.col("p").cast("long"), 33)).alias("i")), "ranks")
    counts = sorted((r["p"], r["n"]) for r in parts.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    begin = rows.sparkSession.createDataFrame(starts, "p int, begin long")
    return parts.join(F.broadcast(begin), "p").select("id", (F.col("begin") + F.col("i")).alias("new_id"))


def id_hash(seed: int, *columns: str) -> Column:
    """Hexadecimal digits of columns (the id) and a seed, which other engines can repeat."""
    return F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in columns or ("id",)], F.lit(str(seed))).cast("binary"))


def shuffle_labels(g: Graph, seed: int = 0) -> Graph:
    """A pseudo-random permutation of the ids, the same for the same seed."""
    ids = g.vertices.select("id")
    return relabel(g, dense_rank_ids(ids, id_hash(seed), F.col("id")))


def degree_order(g: Graph, direction: str = "out") -> DataFrame:
    """id, degree, new_id: vertices by descending degree, ties by id."""
    degrees = g.degrees(direction)
    return degrees.join(dense_rank_ids(degrees, F.col("degree").desc(), F.col("id").asc()), "id")


def renumber_by_degree(g: Graph, direction: str = "out") -> Graph:
    return relabel(g, degree_order(g, direction).select("id", "new_id"))


def sort_by_source(g: Graph) -> Graph:
    """Arcs of a source in one partition, in the order of their ends."""
    return Graph(g.vertices, g.edges.repartition("src").sortWithinPartitions("src", "dst"))


def csr_offsets(g: Graph) -> DataFrame:
    """id, offset, degree: where a vertex's arcs start in the edges sorted by source."""
    w = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    blocked = g.degrees().withColumn("block", F.floor(F.col("id") / OFFSET_BLOCK))
    sums = blocked.groupBy("block").agg(F.sum("degree").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    return blocked.join(before, "block").select("id", (F.col("before") + F.coalesce(F.sum("degree").over(w), F.lit(0))).alias("offset"), "degree")


#: Ids of a block in the running sum; only one number for each block is ordered globally.
OFFSET_BLOCK = 1 << 16


def adjacency(g: Graph, direction: str = "out") -> DataFrame:
    """id, neighbours: sorted, with what repeats."""
    return g.directed(direction).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def remove_multi_arcs(g: Graph) -> Graph:
    """One arc for each pair of ends."""
    return Graph(g.vertices, g.edges.dropDuplicates(["src", "dst"]))


def remove_loops(g: Graph) -> Graph:
    return Graph(g.vertices, g.edges.where("src <> dst"))


def segment_2d(g: Graph, segment: int) -> DataFrame:
    """Edges with the block (of `segment` ids a side) that they lie in, ranged by block."""
    at = lambda c: F.floor(F.col(c) / segment).cast("long")
    return g.edges.withColumn("dst_segment", at("dst")).withColumn("src_segment", at("src")).repartitionByRange("dst_segment", "src_segment")


# Lower degree bounds of the vertex groups.
DEGREE_GROUPS = (256, 128, 64, 32, 16)


def degree_groups(g: Graph, direction: str = "out") -> DataFrame:
    """id, degree, bucket: 0 for the largest degrees, len(DEGREE_GROUPS) for the smallest."""
    bucket = F.lit(len(DEGREE_GROUPS))
    for i, least in reversed(list(enumerate(DEGREE_GROUPS))):
        bucket = F.when(F.col("degree") >= least, i).otherwise(bucket)
    return g.degrees(direction).withColumn("bucket", bucket)


def shards(g: Graph, size: int) -> DataFrame:
    """Edges with a shard: `size` ids of ends each."""
    return g.edges.withColumn("shard", F.floor(F.col("dst") / size).cast("long")).repartition("shard")


def random_vertex(g: Graph, seed: int = 0, with_arcs: bool = True) -> int:
    """A vertex chosen by a hash; with_arcs: only of those that have outgoing ones."""
    ids = g.edges.select(F.col("src").alias("id")).distinct() if with_arcs else g.vertices.select("id")
    return ids.orderBy(id_hash(seed), "id").first()["id"]


def find_edges(g: Graph, src: int, dst: int) -> DataFrame:
    return g.edges.where((F.col("src") == src) & (F.col("dst") == dst))


def count_with_arcs(g: Graph, direction: str = "out") -> int:
    return g.directed(direction).select("src").distinct().count()


def sort_with_positions(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Stable sort: rows of equal key keep the order of their position."""
    return rows.orderBy(F.col(key).desc() if descending else F.col(key).asc(), "position")


def copy_if(rows: DataFrame, predicate: Column) -> DataFrame:
    return rows.where(predicate)


def count_if(rows: DataFrame, predicate: Column) -> int:
    return rows.agg(F.count_if(predicate).alias("n")).first()["n"]


def permute(values: DataFrame, positions: DataFrame) -> DataFrame:
    """position, value: what stands at each position's source; positions(position, source)."""
    return positions.join(values.withColumnRenamed("position", "source"), "source").select("position", "value")


def random_values(rows: DataFrame, name: str, upper: float, seed: int, whole: bool = False) -> DataFrame:
    """A column of values in [0, upper) that depend on the row's columns and the seed alone."""
    u = F.conv(F.substring(id_hash(seed, *rows.columns), 1, 13), 16, 10).cast("long") / float(1 << 52)
    return rows.withColumn(name, F.floor(u * upper).cast("long") if whole else u * upper)
