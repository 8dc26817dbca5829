"""PageRank and HITS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.plans.loop import fixpoint
from graphspark.plans.tables import bucketed

DAMPING = 0.85


def page_rank(g: Graph, iterations: int = 5, direction: str = "forward", damping: float = DAMPING, tolerance: float | None = None) -> DataFrame:
    """id, rank. Starts from 1/V; loops don't count, parallel arcs do; what vertices without arcs hold is spread over all.

    transpose ranks by the reversed arcs. With a tolerance it ends once no rank moves more. What the dangling vertices hold is
    observed while an iteration is written, so the next one needs no global join."""
    if direction not in ("forward", "transpose"):
        raise ValueError(f"direction is forward or transpose, not {direction}")
    clean = Graph(g.vertices, g.edges.where("src <> dst").select("src", "dst"))
    if direction == "transpose":
        clean = clean.reverse()
    n, arcs = g.vertices.count(), bucketed(clean.edges, "arcs", "src")
    state = Graph(g.vertices, arcs).degrees().select("id", "degree", F.lit(1.0 / max(n, 1)).alias("rank"), F.lit(True).alias("changed"))
    dangling = F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("rank"))), F.lit(0.0))

    def step(s: DataFrame, i: int, seen: dict) -> DataFrame:
        sent = s.join(arcs, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("m")).withColumnRenamed("dst", "id")
        new = (1 - damping) / n + damping * (F.coalesce("m", F.lit(0.0)) + F.lit(seen["dangling"] / n))
        moved = F.lit(True) if tolerance is None else F.abs(F.col("new") - F.col("rank")) > tolerance
        return s.join(sent, "id", "left").withColumn("new", new).select("id", "degree", F.col("new").alias("rank"), moved.alias("changed"))

    return fixpoint(step, state, iterations, dangling=dangling).select("id", "rank")


def hits(g: Graph, steps: int = 3) -> DataFrame:
    """id, authority, hub, each of length 1 (zeros if there are no arcs). Loops and parallel arcs count."""
    state = g.vertices.select("id", F.lit(1.0).alias("authority"), F.lit(1.0).alias("hub"))
    arcs = {key: bucketed(g.edges.select("src", "dst"), "arcs", key) for key in ("src", "dst")} if steps else {}
    squares = {"a2": F.sum(F.col("authority") * F.col("authority")), "h2": F.sum(F.col("hub") * F.col("hub"))}
    unit = lambda c, s: F.col(c) / F.lit(s**0.5 if s else 1.0)

    def half(s: DataFrame, i: int, seen: dict) -> DataFrame:
        value, other, key, to = ("hub", "authority", "src", "dst") if i % 2 else ("authority", "hub", "dst", "src")
        if i > 1:
            s = s.withColumn(value, unit(value, seen["h2" if value == "hub" else "a2"]))
        sent = s.join(arcs[key], F.col("id") == F.col(key)).groupBy(to).agg(F.sum(value).alias("m")).withColumnRenamed(to, "id")
        return s.join(sent, "id", "left").withColumn(other, F.coalesce("m", F.lit(0.0))).select("id", "authority", "hub")

    out = fixpoint(half, state, 2 * steps, changed=None, **squares)
    last = out.agg(F.sum(F.col("hub") * F.col("hub")).alias("h2")).first()["h2"] or 0.0
    return out.withColumn("hub", unit("hub", last)) if steps else out
