"""Connected components of the underlying undirected graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators.transforms import dense_rank_ids
from graphspark.plans import blocks
from graphspark.plans.blocks import Blocks
from graphspark.plans.loop import fixpoint, observed
from graphspark.plans.tables import bucketed, forget


def connected_components(g: Graph, method: str = "hook") -> DataFrame:
    """id, component: the smallest id of the component.

    hook: edges are contracted to stars, each of a task's own edges at first, then of ever fewer tasks' together until one holds what is left, fewer than there are vertices; within
    a task roots hook to the smallest neighbouring root and labels jump, so long paths take logarithmically many rounds. Of more than MOST_ROWS vertices labels and
    roots hook in rounds over all arcs. bfs: labels spread from what changed last alone, in blocks of arcs."""
    if method not in ("hook", "bfs"):
        raise ValueError(f"method is hook or bfs, not {method}")
    edges = g.edges.where("src <> dst").select("src", "dst")
    vertices = g.vertices.count()
    if method == "bfs":
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = Blocks(g.vertices, both, n_arcs=2 * edges.count(), n_vertices=vertices).spread_values(blocks.SMALLEST, None, own=True)
    elif vertices > MOST_ROWS:
        return hooked(g)
    else:
        found = stars(edges)
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("value", "id").alias("component"))


#: Vertices of which a task may hold the stars of two others: 32 bytes each, and some four times that while they are joined.
MOST_ROWS = 1 << 23
#: Edges that a task contracts at once, and how many times fewer tasks each step has.
STAR_ROWS, FAN_IN = 1 << 21, 2


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: each vertex but the smallest of its component, and that one."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = place[: len(a)], place[len(a) :], np.arange(len(ids))
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]


def star_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table([pa.array(c) for c in star(a, b)], names=["id", "value"])


def stars(edges: DataFrame) -> DataFrame:
    """id, value (the smallest id of the component) of all vertices with edges but the smallest of each component."""
    most = STAR_ROWS

    def own(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                a, b = star(*map(np.concatenate, zip(*held)))
                if len(a) > n // 2:  # hardly fewer: they go as they are
                    yield from star_table(a, b).to_batches(1 << 16)
                    held, n = [], 0
                else:
                    held, n = [[a, b]], len(a)
        if n:
            yield from star_table(*map(np.concatenate, zip(*held))).to_batches(1 << 16)

    def together(table: pa.Table) -> pa.Table:
        return star_table(table["id"].to_numpy(), table["value"].to_numpy())

    rows, path, seen = observed(edges.mapInArrow(own, "id long, value long"), "stars", n=F.count(F.lit(1)))
    parts = -(-(seen["n"] or 0) // most)
    key = F.pmod(F.xxhash64("id"), F.lit(max(1, parts)))
    while True:
        new, new_path, seen = observed(rows.withColumn("part", key).groupBy("part").applyInArrow(together, "id long, value long"), "stars", n=F.count(F.lit(1)))
        forget(edges.sparkSession, path)
        rows, path = new, new_path
        if parts <= 1:
            return rows
        parts = -(-parts // FAN_IN)
        key = F.pmod(F.xxhash64("id"), F.lit(parts))


def hooked(g: Graph) -> DataFrame:
    """Each label moves to the smallest label of the neighbours, then to its label's label (pointer jumping), in a job a round."""
    arcs = bucketed(g.directed("both").where("src <> dst").select("src", "dst").distinct(), "arcs", "src")
    state = g.vertices.select("id", F.col("id").alias("component"), F.lit(True).alias("changed"))

    def step(s: DataFrame, i: int, seen: dict) -> DataFrame:
        sent = s.join(arcs, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("component").alias("m")).withColumnRenamed("dst", "id")
        new = s.join(sent, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        # The smallest label that a component's members have seen is the one that its root gets: hooks of roots, not of single vertices.
        roots = new.groupBy(F.col("old").alias("root")).agg(F.min("component").alias("to"))
        new = new.join(roots, F.col("component") == F.col("root"), "left").select("id", "old", F.least("component", "to").alias("component"))
        return new.select("id", "component", (F.col("component") < F.col("old")).alias("changed"))

    return fixpoint(step, state)


def numbered(components: DataFrame) -> DataFrame:
    """id, component: numbered from 1 in the order of their smallest ids."""
    roots = components.select(F.col("component").alias("id")).distinct()
    numbers = dense_rank_ids(roots, F.col("id").asc())
    return components.join(numbers.withColumnRenamed("id", "component"), "component").select("id", (F.col("new_id") + 1).alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def size_histogram(components: DataFrame) -> DataFrame:
    """size, components: how many components have each size."""
    return component_sizes(components).groupBy("size").agg(F.count(F.lit(1)).alias("components"))
