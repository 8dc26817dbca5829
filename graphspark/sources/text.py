"""Edge lists and other text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators.transforms import csr_offsets, symmetrize


def read_edge_list(spark: SparkSession, path: str, directed: bool = True, comment: str = "%#", skip_lines: int = 0, weighted: bool = False) -> Graph:
    """Lines of two ids and maybe more, split by white space; comments and lines of another form are left out. The vertices are 0 to
    the largest id; a negative id is an error. skip_lines needs one file, whose lines are numbered as they are read."""
    lines = spark.read.text(path)
    if skip_lines:
        # Spark reads a file in splits of ascending offsets; rows are numbered by split and place, and the first ones left out.
        placed = lines.select("value", F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("place"))
        last = placed.orderBy("split", "place").limit(skip_lines).agg(F.max(F.struct("split", "place")).alias("last"), F.count(F.lit(1)).alias("n")).first()
        lines = placed.where((F.col("split") > last["last"]["split"]) | (F.col("split") == last["last"]["split"]) & (F.col("place") > last["last"]["place"])).select("value") if last["n"] else lines
    marks = "".join(f"\\{c}" for c in comment)
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.where(F.col("value").rlike(r"^\s*-?\d+\s+-?\d+(\s|$)") & ~F.col("value").rlike(rf"^\s*[{marks}]"))
    columns = [fields[0].cast("long").alias("src"), fields[1].cast("long").alias("dst")]
    if weighted:
        columns.append(F.coalesce(F.get(fields, 2).try_cast("double"), F.lit(1.0)).alias("weight"))
    arcs = rows.select(*columns)
    if not arcs.where("src < 0 or dst < 0").isEmpty():
        raise ValueError("an id is negative")
    g = Graph.from_edges(arcs)
    return g if directed else symmetrize(g)


def edge_list_lines(g: Graph, weight: str | None = None, header: bool = False, seed: int = 0) -> DataFrame:
    """Lines "src dst [weight]" with ids from 1; header: first a line "V V E". A weight outside of [0, 100] is drawn anew."""
    low = g.edges.agg(F.min(F.least("src", "dst")).alias("m")).first()["m"]
    shift = 1 if low == 0 else 0
    columns = [(F.col("src") + shift).cast("string"), (F.col("dst") + shift).cast("string")]
    if weight:
        drawn = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(10001)) / 100.0
        columns.append(F.when(F.col(weight).between(0, 100), F.col(weight).cast("double")).otherwise(drawn).cast("string"))
    lines = g.edges.select(F.concat_ws(" ", *columns).alias("value"))
    if header:
        v, e = g.vertices.count() + shift, g.edges.count()
        lines = g.spark.createDataFrame([(f"{v} {v} {e}",)], "value string").unionByName(lines)
    return lines


def write_edge_list(g: Graph, path: str, weight: str | None = None, header: bool = False) -> None:
    """Part files in the order of their names; a header is the first line of the first."""
    edge_list_lines(g, weight, header).write.text(path)


def ligra_lines(g: Graph) -> DataFrame:
    """section, place, value: the lines of an adjacency file in order: its name, V, E, offsets, then ends of arcs by source."""
    v, e = g.vertices.count(), g.edges.count()
    head = g.spark.createDataFrame([(0, 0, 0, "AdjacencyGraph"), (0, 1, 0, str(v)), (0, 2, 0, str(e))], "section int, place long, other long, value string")
    offsets = csr_offsets(g).select(F.lit(1).alias("section"), F.col("id").alias("place"), F.lit(0).cast("long").alias("other"), F.col("offset").cast("string").alias("value"))
    ends = g.edges.select(F.lit(2).alias("section"), F.col("src").alias("place"), F.col("dst").alias("other"), F.col("dst").cast("string").alias("value"))
    return head.unionByName(offsets).unionByName(ends)


def write_ligra(g: Graph, path: str) -> None:
    """The adjacency file as part files, whose lines follow each other in the order of the files."""
    ligra_lines(g).orderBy("section", "place", "other").select("value").write.text(path)


def dot_rows(g: Graph, flows: DataFrame | None = None) -> DataFrame:
    """src, dst, value: a line of a drawing for each arc. With flows(src, dst, capacity, flow) arcs are labelled flow/capacity."""
    if flows is None:
        return g.edges.select("src", "dst", F.format_string("%d -> %d;", "src", "dst").alias("value"))
    plain = lambda c: F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
    label = F.concat(F.lit(' [label = " '), plain(F.least("flow", "capacity")), F.lit("/"), plain(F.col("capacity")), F.lit(' "];'))
    return flows.select("src", "dst", F.concat(F.format_string("%d -> %d", "src", "dst"), label).alias("value"))


#: Arcs that a drawing has at most.
DRAWN = 100_000


def dot_lines(g: Graph, flows: DataFrame | None = None, source: int | None = None, sink: int | None = None) -> list[str]:
    """Lines of a drawing of a small graph, on the driver; a larger one raises (dot_rows has its lines as a table)."""
    rows = dot_rows(g, flows).orderBy("src", "dst").limit(DRAWN + 1).collect()
    if len(rows) > DRAWN:
        raise ValueError(f"a drawing has {DRAWN} arcs at most")
    lines = ["digraph G {", *(f'{v}[label="{name}"];' for v, name in ((source, "source"), (sink, "sink")) if v is not None)]
    return [*lines, *(r["value"] for r in rows), "}"]
