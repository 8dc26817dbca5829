"""Stored graphs: Parquet tables, and the binary edge container."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.plans.tables import forget, materialize
from graphspark.sources import generators, text

# Fixed values of the container: V as int32, E as int64, the kind of file as int32, then all sources and all ends as int32.
HEADER = "<iqi"
EDGES_CONTAINER = 5


def save(g: Graph, path: str, sorted_by_source: bool = False) -> None:
    g.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges = g.edges.repartition("src").sortWithinPartitions("src", "dst") if sorted_by_source else g.edges
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


#: Arcs of a piece that goes through the driver as a whole, on its way into a container.
CONTAINER_PIECE = 1 << 20


def write_container(g: Graph, path: str, kind: int = EDGES_CONTAINER) -> None:
    """One local file. The format asks for all sources and then all ends, so one writer has to see both: executors sort the arcs and pack them
    into pieces, which are written to the shared folder, and the driver copies these one by one, in order."""

    def pack(batches):
        held, n = [], 0

        def piece():
            src, dst = (np.concatenate(c).astype("<i4").tobytes() for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([held[0][0][0]], pa.int64()), pa.array([held[0][1][0]], pa.int64()), pa.array([n], pa.int64()), pa.array([src], pa.binary()), pa.array([dst], pa.binary())], names=["s", "d", "n", "src", "dst"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                n += batch.num_rows
            if n >= CONTAINER_PIECE:
                yield piece()
                held, n = [], 0
        if n:
            yield piece()

    pieces, where = materialize(g.edges.select("src", "dst").orderBy("src", "dst").mapInArrow(pack, "s long, d long, n long, src binary, dst binary"), "container")
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, g.vertices.count(), pieces.agg(F.sum("n")).first()[0] or 0, kind))
        for column in ("src", "dst"):
            for row in pieces.orderBy("s", "d", "n").select(column).toLocalIterator():
                f.write(row[0])
    forget(g.spark, where)


def read_container(spark: SparkSession, path: str) -> Graph:
    """Containers of up to 2 GB each; all of them together are one edge table over the largest V."""

    def parse(batches):
        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_py()
                v, e, _ = struct.unpack_from(HEADER, data)
                at = struct.calcsize(HEADER)
                src, dst = np.frombuffer(data, "<i4", e, at), np.frombuffer(data, "<i4", e, at + 4 * e)
                for lo in range(0, max(e, 1), 1 << 20):
                    s, d = src[lo : lo + (1 << 20)].astype(np.int64), dst[lo : lo + (1 << 20)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], names=["src", "dst"])

    files = spark.read.format("binaryFile").load(path)
    arcs = files.select("content").mapInArrow(parse, "src long, dst long")
    counts = files.select("content").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([struct.unpack_from(HEADER, c.as_py())[0] for c in b.column(0)], pa.int64())], names=["v"]) for b in batches), "v long")
    return Graph(spark.range(counts.agg(F.max("v").alias("v")).first()["v"] or 0), arcs)


def prepare(spark: SparkSession, mode: str, path: str | None = None, **options) -> Graph:
    """generate (kind=rmat, uniform, blocks or kronecker), load a stored graph, or import an edge list or container."""
    if mode == "generate":
        kind = options.pop("kind", "rmat")
        makers = {"rmat": generators.rmat, "uniform": generators.uniform, "blocks": generators.strong_blocks, "kronecker": generators.kronecker}
        return makers[kind](spark, **options)
    if mode == "load":
        return load(spark, path)
    if mode == "import":
        return read_container(spark, path) if path.endswith(".el_container") else text.read_edge_list(spark, path, **options)
    raise ValueError(f"mode is generate, load or import, not {mode}")


def describe(g: Graph, show: int = 32) -> str:
    """Counts, and the arcs of a small graph."""
    v, e = g.vertices.count(), g.edges.count()
    lines = [f"{v} vertices, {e} edges, columns {', '.join(g.edges.columns)}"]
    if v <= show and e <= 4 * show:
        lines += [f"{r['id']}: {r['neighbours']}" for r in g.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours")).orderBy("id").collect()]
    return "\n".join(lines)
