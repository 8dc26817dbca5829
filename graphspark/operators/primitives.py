"""The primitives: scatter, gather, compute, reduce and new_frontier, on column expressions.

A frontier is a DataFrame of ids, or None for all vertices. Messages see the columns of the active vertex as src_*, those of the
other end as dst_*, and the arc's own. What arrives at a vertex is folded by a monoid, which Spark applies before and after
the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph

MONOIDS = {
    "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count, "any": F.bool_or, "all": F.bool_and, "bit_and": F.bit_and, "bit_or": F.bit_or, "mode": F.mode, "collect_set": F.collect_set,
}


def fold(agg: str, value: Column) -> Column:
    if agg not in MONOIDS:
        raise ValueError(f"{agg} is none of {sorted(MONOIDS)}")
    return MONOIDS[agg](value)


def advance(g: Graph, message: Column, agg: str, state: DataFrame | None = None, frontier: DataFrame | None = None, direction: str = "out", to: str = "dst", where: Column | None = None, read_other: bool = False) -> DataFrame:
    """id, message: what each vertex receives. read_other joins the state of the other end too; only then is the state read twice."""
    arcs = g.directed(direction)
    if frontier is not None:
        arcs = arcs.join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
    if state is not None:
        arcs = arcs.join(state.select(*[F.col(c).alias("src" if c == "id" else f"src_{c}") for c in state.columns]), "src")
        if read_other:
            arcs = arcs.join(state.select(*[F.col(c).alias("dst" if c == "id" else f"dst_{c}") for c in state.columns]), "dst")
    if where is not None:
        arcs = arcs.where(where)
    return arcs.groupBy(F.col(to).alias("id")).agg(fold(agg, message).alias("message"))


def scatter(g: Graph, message: Column, agg: str, state: DataFrame | None = None, frontier: DataFrame | None = None, **options) -> DataFrame:
    """Along the outgoing arcs of the active vertices."""
    return advance(g, message, agg, state, frontier, "out", **options)


def gather(g: Graph, message: Column, agg: str, state: DataFrame | None = None, frontier: DataFrame | None = None, **options) -> DataFrame:
    """Along the incoming arcs of the active vertices: src is the active one, dst its neighbour; by default it receives."""
    return advance(g, message, agg, state, frontier, "in", **{"to": "src"} | options)


def edge_compute(g: Graph, **columns: Column) -> Graph:
    """Columns of the arcs; both directions see them."""
    return Graph(g.vertices, g.edges.withColumns(columns))


def compute(state: DataFrame, frontier: DataFrame | None = None, **columns: Column) -> DataFrame:
    """New values of columns at the active vertices; the others keep theirs (null if the column is new)."""
    if frontier is None:
        return state.withColumns(columns)
    marked = state.join(frontier.select("id").distinct().withColumn("__active", F.lit(True)), "id", "left")
    old = {k: F.col(k) if k in state.columns else F.lit(None) for k in columns}
    return marked.withColumns({k: F.when(F.col("__active"), v).otherwise(old[k]) for k, v in columns.items()}).drop("__active")


def reduce(state: DataFrame, value: Column, agg: str, frontier: DataFrame | None = None):
    """One number over the active vertices; None if there are none."""
    if frontier is not None:
        state = state.join(frontier.select("id"), "id", "left_semi")
    return state.agg(fold(agg, value).alias("v")).first()["v"]


def new_frontier(state: DataFrame, predicate: Column) -> DataFrame:
    return state.where(predicate).select("id")


def all_active(g: Graph) -> DataFrame:
    return g.vertices.select("id")


def frontier_of(g: Graph, *ids: int) -> DataFrame:
    return g.spark.createDataFrame([(i,) for i in ids], "id long").distinct()


def add_to_frontier(frontier: DataFrame, more: DataFrame) -> DataFrame:
    return frontier.select("id").unionByName(more.select("id")).distinct()


#: A frontier with a larger share of the vertices is dense.
DENSE = 0.7


def frontier_stats(g: Graph, frontier: DataFrame | None = None, direction: str = "out") -> DataFrame:
    """size, neighbours (arcs that leave it) and sparsity (ALL_ACTIVE, DENSE or SPARSE) as one row."""
    degrees = g.degrees(direction)
    inside = F.lit(True)
    if frontier is not None:
        degrees = degrees.join(frontier.select("id").distinct().withColumn("__in", F.lit(True)), "id", "left")
        inside = F.coalesce("__in", F.lit(False))
    row = degrees.agg(F.count_if(inside).alias("size"), F.coalesce(F.sum(F.when(inside, F.col("degree"))), F.lit(0)).alias("neighbours"), F.count(F.lit(1)).alias("v"))
    share = F.col("size") / F.greatest("v", F.lit(1))
    return row.select("size", "neighbours", F.when(F.col("size") == F.col("v"), "ALL_ACTIVE").when(share > DENSE, "DENSE").otherwise("SPARSE").alias("sparsity"))


def pack(state: DataFrame, a: str, b: str, name: str = "packed") -> DataFrame:
    return state.withColumn(name, F.struct(a, b)).drop(a, b)


def unpack(state: DataFrame, name: str = "packed") -> DataFrame:
    return state.select(*[c for c in state.columns if c != name], f"{name}.*")


def exchange(parts: list[DataFrame], agg: str, value: str, previous: DataFrame | None = None) -> DataFrame:
    """id, value: versions of one vertex property merged by a monoid. With the previous version only what changed takes part."""
    changed = []
    for p in parts:
        if previous is not None:
            old = previous.select("id", F.col(value).alias("__old"))
            p = p.join(old, "id", "left").where(~F.col(value).eqNullSafe(F.col("__old"))).drop("__old")
        changed.append(p.select("id", value))
    if previous is not None:
        changed.append(previous.select("id", value))
    merged = changed[0]
    for p in changed[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy("id").agg(fold(agg, F.col(value)).alias(value))
