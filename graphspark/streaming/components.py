"""Components of a stream of edges: each micro-batch joins what the ones before it found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators.components import connected_components
from graphspark.plans.tables import forget, materialize


class StreamingComponents:
    """Keeps id, component of all vertices seen. A batch only touches the components that its arcs lead to: the arcs are lifted to
    component labels, whose graph is solved, and the labels are renamed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.state, self.path = spark.createDataFrame([], "id long, component long"), None

    def add(self, batch: DataFrame, batch_id: int = 0) -> None:
        arcs, arcs_path = materialize(batch.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct(), "stream-arcs")
        new = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(self.state, "id", "left_anti")
        known = self.state.unionByName(new.select("id", F.col("id").alias("component")))
        by = lambda end: known.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c"))
        lifted = arcs.join(by("src"), "src").join(by("dst"), "dst").where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct()
        lifted, lifted_path = materialize(lifted, "stream-lifted")
        touched = lifted.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        renamed = connected_components(Graph(touched, lifted)).select(F.col("id").alias("component"), F.col("component").alias("to"))
        state = known.join(renamed, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        state, path = materialize(state, "stream-components")
        for old in (self.path, arcs_path, lifted_path):
            if old:
                forget(self.spark, old)
        self.state, self.path = state, path

    def start(self, edges: DataFrame, checkpoint: str | None = None):
        """A streaming query over readStream edges; state is what add() keeps."""
        writer = edges.writeStream.foreachBatch(self.add)
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
