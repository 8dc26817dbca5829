"""Random walks with reproducible choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.plans.loop import fixpoint
from graphspark.plans.tables import bucketed

# Fixed value: where a walk that can't go on stands.
DEAD_END = -1


def random_walk(g: Graph, starts: DataFrame, length: int, seed: int = 42, paths: bool = False) -> DataFrame:
    """starts(walk long, id long): walk, start, end (DEAD_END if it was stuck), and with paths the vertices on the way.

    Step t of a walk takes the arc numbered (walk * 7919 + t * 104729 + seed) mod degree in the order of arcs' ends. Arcs
    are looked up by vertex and number; no list of neighbours is built."""
    number = (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long")
    # A walk finds its arc by one key of vertex and number, by which arcs are stored: those of a vertex with very many are spread.
    numbered = g.edges.select(F.col("src").alias("at"), "dst", number.alias("number"))
    arcs = bucketed(numbered.select(F.xxhash64("at", "number").alias("arc"), "at", "number", "dst"), "arcs", "arc")
    stored = arcs.select("arc", F.col("at").alias("arc_at"), F.col("number").alias("arc_number"), "dst")
    degrees = bucketed(g.edges.groupBy(F.col("src").alias("at")).agg(F.count(F.lit(1)).alias("degree")), "degrees", "at")
    state = starts.select("walk", F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("path"), F.lit(True).alias("changed"))
    if not paths:
        state = state.drop("path")

    def step(s: DataFrame, i: int, seen: dict) -> DataFrame:
        pick = F.pmod(F.col("walk") * 7919 + (i - 1) * 104729 + seed, F.col("degree"))
        asked = s.join(degrees, "at", "left").withColumn("number", pick)
        chosen = asked.join(stored, F.expr("xxhash64(at, number) = arc and at = arc_at and number = arc_number"), "left")
        end = F.coalesce("dst", F.lit(DEAD_END).cast("long"))
        columns = ["walk", "start", end.alias("at")] + ([F.when(end == DEAD_END, F.col("path")).otherwise(F.concat("path", F.array(end))).alias("path")] if paths else [])
        return chosen.select(*columns, (end != DEAD_END).alias("changed"))

    return fixpoint(step, state, length).withColumnRenamed("at", "end")
