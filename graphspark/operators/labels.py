"""Synchronous label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.plans.loop import fixpoint
from graphspark.plans.tables import bucketed

ACTIVITIES = ("always", "inner", "previous", "recent")
# A passive vertex becomes active when more than this share of its neighbours has changed; rounds without a change after
# which a vertex rests.
REACTIVATE, PATIENCE = 0.006, 4


def label_propagation(g: Graph, iterations: int = 20, activity: str = "always", direction: str = "out") -> DataFrame:
    """id, label. Every vertex starts with its id; in a round it takes the label that most of its neighbours have (arcs counted), the
    largest of equals. Ends when nothing changes.

    activity says which vertices look again: always all; inner: those not surrounded by their own label, and those of whose
    neighbours more than REACTIVATE changed; previous: those that changed last round; recent: those that changed within
    PATIENCE rounds."""
    if activity not in ACTIVITIES:
        raise ValueError(f"activity is one of {ACTIVITIES}, not {activity}")
    arcs = bucketed(g.directed(direction).select("src", "dst"), "arcs", "dst")
    state = g.vertices.select("id", F.col("id").alias("label"), F.lit(0).alias("rest"), F.lit(True).alias("active"), F.lit(True).alias("changed"))

    def step(s: DataFrame, i: int, seen: dict) -> DataFrame:
        seen_by = arcs.join(s.select(F.col("id").alias("dst"), "label"), "dst")
        if activity != "always":
            seen_by = seen_by.join(s.where("active").select(F.col("id").alias("src")), "src", "left_semi")
        votes = seen_by.groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("n", "label")).alias("best"), F.count(F.lit(1)).alias("kinds"))
        new = s.join(best, "id", "left").withColumn("new", F.coalesce("best.label", "label")).withColumn("moved", F.col("new") != F.col("label"))
        rest = F.when(F.col("moved"), 0).otherwise(F.col("rest") + 1)
        if activity == "always":
            active = F.lit(True)
        elif activity == "previous":
            active = F.col("moved")
        elif activity == "recent":
            active = rest <= PATIENCE
        else:
            moved = new.where("moved").select(F.col("id").alias("dst"))
            shares = arcs.join(moved.withColumn("m", F.lit(1)), "dst", "left").groupBy(F.col("src").alias("id")).agg((F.count("m") / F.count(F.lit(1))).alias("share"))
            new = new.join(shares, "id", "left")
            surrounded = F.col("active") & (F.coalesce("kinds", F.lit(0)) <= 1)
            active = (F.col("active") & ~surrounded) | (F.coalesce("share", F.lit(0.0)) > REACTIVATE)
        return new.select("id", F.col("new").alias("label"), rest.alias("rest"), active.alias("active"), F.col("moved").alias("changed"))

    return fixpoint(step, state, iterations).select("id", "label")
