"""Vertex colouring: greedy in the order of ids, in parallel rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.plans.blocks import BLOCK_ARCS
from graphspark.plans.loop import fixpoint, observed
from graphspark.plans.tables import bucketed, forget


#: Arcs of a graph that one task colours.
TASK_ARCS = BLOCK_ARCS


def colour(g: Graph) -> DataFrame:
    """id, colour (from 0): the smallest that no neighbour with a smaller id has; loops don't count.

    Up to TASK_ARCS arcs are coloured by one task in the order of ids. Of more, in a round every vertex whose smaller neighbours are all coloured takes its colour, so
    the result doesn't depend on how many take theirs at once. A vertex gathers the set of colours around it, of which there are far fewer than neighbours. States are
    shuffled, never broadcast."""
    pairs = g.edges.where("src <> dst").select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("id")).distinct()
    pairs, path, seen = observed(pairs, "colour-arcs", n=F.count(F.lit(1)))
    if (seen["n"] or 0) <= TASK_ARCS:
        found = pairs.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(in_order, "id long, colour long")
        return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("colour", F.lit(0).cast("long")).alias("colour"))
    both = bucketed(pairs, "arcs", "id")
    forget(g.spark, path)
    state = g.vertices.select("id", F.lit(None).cast("long").alias("colour"), F.lit(True).alias("changed"))

    def step(s: DataFrame, i: int, seen: dict) -> DataFrame:
        lower = s.select(F.col("id").alias("low"), F.col("colour").alias("low_colour"))
        todo = both.join(s.where("colour is null").select("id").hint("merge"), "id", "left_semi")
        around = todo.join(lower.hint("merge"), "low").groupBy("id").agg(F.count_if(F.col("low_colour").isNull()).alias("waiting"), F.collect_set("low_colour").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.size("used").cast("long")), F.col("used")))
        ready = F.col("colour").isNull() & (F.coalesce("waiting", F.lit(0)) == 0)
        return s.join(around.hint("merge"), "id", "left").select("id", F.when(ready, F.coalesce(free, F.lit(0).cast("long"))).otherwise(F.col("colour")).alias("colour"), ready.alias("changed"))

    return fixpoint(step, state)


def in_order(table: pa.Table) -> pa.Table:
    """id, colour of the vertices that have neighbours with a smaller id; the others' is 0."""
    low, high = table["low"].to_numpy(), table["id"].to_numpy()
    order = np.argsort(high, kind="stable")
    ids, begin = np.unique(high[order], return_index=True)
    at = np.minimum(np.searchsorted(ids, low[order]), max(len(ids) - 1, 0))
    before = np.where(ids[at] == low[order], at, len(ids)).tolist() if len(ids) else []
    colours = [0] * (len(ids) + 1)
    for v, (lo, hi) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), len(before)])):
        used = {colours[u] for u in before[lo:hi]}
        c = 0
        while c in used:
            c += 1
        colours[v] = c
    return pa.table([pa.array(ids), pa.array(np.array(colours[:-1], np.int64))], names=["id", "colour"])
