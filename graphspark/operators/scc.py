"""Strong components by trimming, forward colours and backward search; the graph of components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.plans import blocks
from graphspark.plans.blocks import Blocks
from graphspark.plans.loop import observed
from graphspark.plans.tables import forget, materialize

#: Trims before each colouring at most; they end when less than one of TRIM_SHARE arcs goes.
TRIMS, TRIM_SHARE = 3, 16
#: Arcs whose strong components one task finds.
TASK_ARCS = blocks.BLOCK_ARCS


def strong_components(g: Graph) -> DataFrame:
    """id, component: the smallest id of the vertex's strong component.

    While there are more than TASK_ARCS arcs: vertices without arcs in one direction are components of their own (trim); the others learn the smallest id
    that leads to them (colour); those that lead back to that id within their colour are its component. Every colour finds
    its component in the same pass, and arcs between colours or to what is done are dropped. Both searches go by blocks of arcs. What is left is one task's, in time that grows
    as the arcs."""
    spark = g.spark

    def written(rows: DataFrame) -> tuple[DataFrame, int]:
        table, path, seen = observed(rows, "scc-arcs", n=F.count(F.lit(1)))
        held.append(path)
        for old in held[:-1]:
            forget(spark, old)
        del held[:-1]
        return table, seen["n"] or 0

    held: list[str] = []
    arcs, n = written(g.edges.where("src <> dst").select("src", "dst").distinct())
    done = []
    while n:
        if n <= TASK_ARCS:
            done.append(materialize(arcs.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(small_components, "id long, component long"), "scc-labels")[0])
            break
        for _ in range(TRIMS):
            inner = arcs.select(F.col("src").alias("v")).distinct().intersect(arcs.select("dst").distinct()).hint("merge")
            before = n
            arcs, n = written(arcs.join(inner.withColumnRenamed("v", "src"), "src", "left_semi").join(inner.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"))
            if (before - n) * TRIM_SHARE < before:
                break
        if not n:
            break
        ids = materialize(arcs.select("src").unionByName(arcs.select(F.col("dst").alias("src"))).distinct().withColumnRenamed("src", "id"), "scc-ids")[0]
        colour = Blocks(ids, arcs, n_arcs=n).spread_values(blocks.SMALLEST, None, own=True).withColumnRenamed("value", "colour")
        colour, _ = materialize(colour, "scc-colours")
        by = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour")).hint("merge")
        inside, n_inside = written(arcs.join(by("src"), "src").join(by("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))
        back = Blocks(ids, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), n_arcs=n_inside)
        found = back.spread_values(blocks.SMALLEST, colour.where("id = colour").select("id", F.lit(1).cast("long").alias("value"))).select("id")
        labels, _ = materialize(found.join(colour, "id").select("id", F.col("colour").alias("component")), "scc-labels")
        done.append(labels)
        gone = labels.select("id").hint("merge")
        arcs, n = written(inside.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    known = spark.createDataFrame([], "id long, component long") if not done else done[0]
    for labels in done[1:]:
        known = known.unionByName(labels)
    return g.vertices.select("id").join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def small_components(table: pa.Table) -> pa.Table:
    """id, component of the vertices that aren't a component of their own, from all arcs that may matter: Tarjan's search."""
    ids, place = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy()]), return_inverse=True)
    src, dst = place[: table.num_rows], place[table.num_rows :]
    while len(src):  # without arcs in one direction: no member of a cycle
        alive = (np.bincount(src, minlength=len(ids)) > 0) & (np.bincount(dst, minlength=len(ids)) > 0)
        some = alive[src] & alive[dst]
        few = (~some).sum() * 64 < len(some)
        src, dst = src[some], dst[some]
        if few:
            break
    order = np.argsort(src, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))])
    to, at, end = dst[order].tolist(), begin[:-1].tolist(), begin[1:].tolist()
    # number: 0 not met, from 1 the order of meeting; low: the first met that is reached and still open, or a bound beyond all once a component is closed.
    n = len(ids)
    number, low, root = [0] * n, [0] * n, np.arange(n)
    met, opened = 0, []
    for first in np.unique(src).tolist():
        if number[first]:
            continue
        path = [first]
        met += 1
        number[first] = low[first] = met
        opened.append(first)
        while path:
            v = path[-1]
            if at[v] < end[v]:
                u = to[at[v]]
                at[v] += 1
                if not number[u]:
                    met += 1
                    number[u] = low[u] = met
                    opened.append(u)
                    path.append(u)
                elif low[u] < low[v]:
                    low[v] = low[u]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == number[v]:
                members = []
                while True:
                    u = opened.pop()
                    low[u] = n + 1
                    members.append(u)
                    if u == v:
                        break
                if len(members) > 1:
                    root[members] = min(members)
    some = np.flatnonzero(np.bincount(root, minlength=n)[root] > 1)
    return pa.table([pa.array(ids[some]), pa.array(ids[root[some]])], names=["id", "component"])


def condensation(g: Graph, labels: DataFrame) -> DataFrame:
    """src, dst: arcs between components, once each."""
    by = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c")).hint("merge")
    joined = g.edges.select("src", "dst").join(by("src"), "src").join(by("dst"), "dst")
    return joined.where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct()
