"""The data model: a directed multigraph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.plans.tables import materialize


@dataclass
class Graph:
    """vertices(id long, ...) and edges(src long, dst long, ...). Parallel arcs and loops are kept; isolated vertices
    exist; there is one id space and both directions read the same edges."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        edges = edges.withColumn("src", F.col("src").cast("long")).withColumn("dst", F.col("dst").cast("long"))
        if vertices is None:
            top = edges.agg(F.max(F.greatest("src", "dst")).alias("m")).first()["m"]
            vertices = edges.sparkSession.range(0 if top is None else top + 1)
        return cls(vertices.withColumn("id", F.col("id").cast("long")), edges)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def validate(self) -> Graph:
        """Raises if a column is absent, an id repeats, or an arc ends outside of the vertices."""
        missing = {"src", "dst"} - set(self.edges.columns) | {"id"} - set(self.vertices.columns)
        if missing:
            raise ValueError(f"columns are absent: {sorted(missing)}")
        if not self.vertices.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("vertex ids repeat")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if not ends.join(self.vertices, "id", "left_anti").isEmpty():
            raise ValueError("an arc ends outside of the vertices")
        return self

    def stored(self) -> Graph:
        """The same graph with both tables materialized; loops read them instead of computing them again."""
        return Graph(materialize(self.vertices, "vertices")[0], materialize(self.edges, "edges")[0])

    def reverse(self) -> Graph:
        swap = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
        return Graph(self.vertices, self.edges.select(*[swap.get(c, F.col(f"`{c}`")) for c in self.edges.columns]))

    def directed(self, direction: str) -> DataFrame:
        """Edges from the active end (src) to the other (dst): "out" follows arcs, "in" goes against them, "both" either way."""
        if direction == "out":
            return self.edges
        if direction == "in":
            return self.reverse().edges
        if direction == "both":
            return self.edges.unionByName(self.reverse().edges)
        raise ValueError(f"direction is out, in or both, not {direction}")

    def degrees(self, direction: str = "out") -> DataFrame:
        """id, degree: stored arcs of every vertex, 0 included."""
        counts = self.directed(direction).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(counts, "id", "left").fillna(0, ["degree"])
