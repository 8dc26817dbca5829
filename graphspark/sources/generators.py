"""Synthetic graphs; the same seed gives the same graph whatever the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators.transforms import shuffle_labels

# Quadrant probabilities in percent.
QUADRANTS = (57, 19, 19, 5)


def digest(*parts) -> Column:
    """Hexadecimal digits that depend on the parts alone, and that other engines can repeat."""
    return F.md5(F.concat_ws("/", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]).cast("binary"))


def uniform01(*parts) -> Column:
    """A number in [0, 1) that depends on its parts alone."""
    return F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("long") / float(1 << 52)


def finish(spark: SparkSession, arcs: DataFrame, vertices: int, directed: bool) -> Graph:
    """An undirected graph has both arcs of every edge, and no more."""
    if not directed:
        arcs = Graph(spark.range(vertices), arcs).directed("both")
    return Graph(spark.range(vertices), arcs)


def rmat(spark: SparkSession, scale: int, edges: int, quadrants: tuple[int, int, int, int] = QUADRANTS, directed: bool = True, seed: int = 0, shuffle: bool = False) -> Graph:
    """2**scale vertices; each bit of both ends is chosen by a quadrant. Every bit is a column expression of a digest of the arc's number."""
    a, b, c, _ = quadrants
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(scale):
        # A digest has eight numbers of 16 bits.
        u = F.conv(F.substring(F.col(f"d{bit // 8}"), 1 + 4 * (bit % 8), 4), 16, 10).cast("long") / 65536.0
        down = F.when(u >= (a + b) / 100, F.lit(1 << bit)).otherwise(F.lit(0))
        right = F.when(((u >= a / 100) & (u < (a + b) / 100)) | (u >= (a + b + c) / 100), F.lit(1 << bit)).otherwise(F.lit(0))
        src, dst = src + down, dst + right
    drawn = spark.range(edges).select(*[digest(F.col("id"), seed, k).alias(f"d{k}") for k in range(-(-scale // 8))])
    g = finish(spark, drawn.select(src.alias("src"), dst.alias("dst")), 1 << scale, directed)
    return shuffle_labels(g, seed) if shuffle else g


def uniform(spark: SparkSession, vertices: int, edges: int, directed: bool = True, seed: int = 0) -> Graph:
    end = lambda k: F.floor(uniform01(F.col("id"), seed, k) * vertices).cast("long")
    return finish(spark, spark.range(edges).select(end("src").alias("src"), end("dst").alias("dst")), vertices, directed)


def strong_blocks(spark: SparkSession, vertices: int, block: int, seed: int = 0) -> Graph:
    """Blocks of ids, each a directed cycle with one more random arc inside and one to a later block: every block is a
    strong component."""
    at = F.floor(F.col("id") / block) * block
    size = F.least(F.lit(block), F.lit(vertices) - at)
    ring = F.struct(F.col("id").alias("src"), (at + F.pmod(F.col("id") - at + 1, size)).cast("long").alias("dst"))
    inside = F.struct(F.col("id").alias("src"), (at + F.floor(uniform01(F.col("id"), seed, 1) * size)).cast("long").alias("dst"))
    later = at + block + F.floor(uniform01(F.col("id"), seed, 2) * F.greatest(F.lit(vertices) - at - block, F.lit(0)))
    outside = F.struct(F.col("id").alias("src"), later.cast("long").alias("dst"))
    arcs = spark.range(vertices).select(F.explode(F.array(ring, inside, outside)).alias("e")).select("e.*").where(F.col("dst") < vertices)
    return Graph(spark.range(vertices), arcs)


def kronecker(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 0) -> Graph:
    """R-MAT with labels permuted alike at both ends, and a weight in [0, 1)."""
    g = rmat(spark, scale, edge_factor << scale, directed=True, seed=seed)
    weighted = g.edges.withColumn("weight", uniform01(F.col("src"), F.col("dst"), seed, 99))
    return shuffle_labels(Graph(g.vertices, weighted), seed)


def co_purchase(spark: SparkSession, sf_dir: str, kind: str = "dense") -> Graph:
    """Parts as vertices; an arc joins the parts of consecutive lines of an order. weight: the least quantity, mult: how often.

    sparse: lines of at least 25 pieces, of which the first was returned; forest: large discounts, then at least 30 pieces."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"), F.col("l_quantity").alias("weight"), "l_discount", "l_returnflag")
    b = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("q"))
    if kind == "sparse":
        a, b = a.where("weight >= 25 and l_returnflag = 'R'"), b.where("q >= 25")
    elif kind == "forest":
        a, b = a.where("l_discount >= 0.09"), b.where("q >= 30")
    elif kind != "dense":
        raise ValueError(f"kind is dense, sparse or forest, not {kind}")
    arcs = a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("src", "dst").agg(F.min("weight").alias("weight"), F.count(F.lit(1)).alias("mult"))
    return Graph(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id")), arcs)
