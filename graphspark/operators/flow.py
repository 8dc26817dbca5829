"""Maximum flow by shortest augmenting paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.plans import blocks
from graphspark.plans.blocks import Blocks
from graphspark.plans.tables import materialize

#: Arcs of a block that is searched in one task.
BLOCK_ARCS = blocks.BLOCK_ARCS


def max_flow(g: Graph, source: int, sink: int, capacity: str = "weight") -> tuple[float, DataFrame]:
    """The value, and flows(src, dst, capacity, flow): capacities of parallel arcs are summed, loops dropped.

    Each round searches from the source along residual arcs, by blocks of arcs, and pushes as much as the least residual along one path: a shortest one, of several ways
    to a vertex the one from the smallest id. Arcs stay where they are: the driver keeps the residuals of those on paths so far and tells them to the tasks."""
    if source == sink:
        raise ValueError("source and sink are the same vertex")
    arcs = g.edges.where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col(capacity).cast("double")).alias("capacity"))
    pairs = arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("capacity")))
    residual, _ = materialize(pairs.groupBy("src", "dst").agg(F.sum("capacity").alias("capacity")), "residual")
    held = Blocks(g.vertices, residual.select("src", "dst", F.col("capacity").alias("w")), limit=BLOCK_ARCS)
    changed: dict[tuple[int, int], float] = {}
    total = 0.0
    while (hops := augmenting_path(held, changed, source, sink)) is not None:
        steps = list(zip(hops, hops[1:]))
        new = [p for a, b in steps for p in ((a, b), (b, a)) if p not in changed]
        if new:
            rows = residual.where(F.col("src").isin(sorted({a for a, _ in new})) & F.col("dst").isin(sorted({b for _, b in new}))).collect()
            at = {(r["src"], r["dst"]): r["capacity"] for r in rows}
            changed |= {p: at[p] for p in new}
        amount = min(changed[p] for p in steps)
        total += amount
        for a, b in steps:
            changed[(a, b)] -= amount
            changed[(b, a)] += amount
    change = g.spark.createDataFrame([(a, b, r) for (a, b), r in changed.items()], "src long, dst long, residual double")
    left = residual.join(change, ["src", "dst"], "left").select("src", "dst", "capacity", F.coalesce("residual", "capacity").alias("residual"))
    flows = left.where("capacity > 0").select("src", "dst", "capacity", F.greatest(F.col("capacity") - F.col("residual"), F.lit(0.0)).alias("flow"))
    return total, flows


def augmenting_path(held: Blocks, changed: dict[tuple[int, int], float], source: int, sink: int) -> list[int] | None:
    """The vertices of a shortest path along open arcs; what leads to each is its smallest neighbour a hop nearer to the source."""
    told = np.array([p for p in changed], np.int64).reshape(-1, 2), np.array(list(changed.values()), np.float64)
    rule = blocks.parents(lambda b: residuals(b, *told))
    start = held.spark.createDataFrame([(source, 1)], "id long, value long")
    state, path = held.spread(rule, start), [sink]
    while path[-1] != source:
        # A block is followed as far as it has the vertices: a job for each change of blocks, not for each hop.
        found = held.read(state, rule, "place long, id long", lambda ids, values, at=path[-1]: followed(ids, values, at, source)).collect()
        if not found:
            return None
        path += [r["id"] for r in sorted(found, key=lambda r: r["place"])]
    return path[::-1]


def residuals(b: dict, pairs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Weights of a block's arcs, those of some pairs of vertices replaced."""
    w, ids, ends, ptr = b["w"].copy(), b["ids"], b["ends"], b["ptr"]
    if not len(ids) or not len(ends):
        return w
    i, j = (np.minimum(np.searchsorted(x, pairs[:, k]), len(x) - 1) for k, x in enumerate((ids, ends)))
    here = np.flatnonzero((ids[i] == pairs[:, 0]) & (ends[j] == pairs[:, 1]))
    for k in here.tolist():
        lo, hi = ptr[i[k]], ptr[i[k] + 1]
        w[lo:hi][b["dst"][lo:hi] == j[k]] = values[k]
    return w


def followed(ids: np.ndarray, values: np.ndarray, at: int, source: int) -> pa.Table:
    """What leads to a vertex, to that one and so on, as far as these vertices go; nothing if the first isn't among them or wasn't reached."""
    out = []
    while at != source:
        i = int(np.searchsorted(ids, at))
        if i == len(ids) or ids[i] != at or values[i, 0] == blocks.FAR:
            break
        at = int(values[i, 1])
        out.append(at)
    return pa.table([pa.array(range(len(out)), pa.int64()), pa.array(out, pa.int64())], names=["place", "id"])
