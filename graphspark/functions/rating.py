"""Benchmark results as a table, and the rating of architectures by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_many(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def matching(criteria: dict) -> Column:
    """All columns equal; no criteria match everything."""
    out = F.lit(True)
    for k, v in criteria.items():
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def find(table: DataFrame, criteria: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = table.where(matching(criteria or {}))
    return rows.select(*columns) if columns else rows


def find_one(table: DataFrame, criteria: dict | None = None) -> DataFrame:
    return find(table, criteria).limit(1)


def distinct_values(table: DataFrame, criteria: dict, column: str) -> DataFrame:
    return find(table, criteria, [column]).distinct()


def count_documents(table: DataFrame, criteria: dict | None = None) -> int:
    return find(table, criteria).count()


def update_many(table: DataFrame, criteria: dict, values: dict) -> DataFrame:
    return table.withColumns({k: F.when(matching(criteria), F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def remove(table: DataFrame, criteria: dict) -> DataFrame:
    return table.where(~matching(criteria))


def upsert_max(table: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("graph_name", "arch_name", "app_name"), value: str = "perf_val") -> DataFrame:
    """One row for each key with the highest value of either table."""
    return table.select(*keys, value).unionByName(rows.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


# Categories by the start of a graph's name, and scales by the number of its vertices.
CATEGORIES = {"web_": "Hyperlink network", "soc_": "Online social network", "rating_": "Rating network", "road_": "Infrastructure network", "syn_": "synthetic"}
SCALES = {1 << 16: "tiny_vertex_scale", 1 << 22: "small_vertex_scale", 1 << 24: "medium_vertex_scale"}
LARGEST_SCALE = "large_vertex_scale"


def category(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, value in CATEGORIES.items():
        out = F.when(name.startswith(prefix), value).otherwise(out)
    return out


def vertex_scale(vertices: Column) -> Column:
    out = F.lit(LARGEST_SCALE)
    for bound, value in sorted(SCALES.items(), reverse=True):
        out = F.when(vertices < bound, value).otherwise(out)
    return out


def synthetic_vertices(name: Column) -> Column:
    """syn_<kind>_<log2 of the vertices>_<degree>"""
    return F.pow(F.lit(2.0), F.regexp_extract(name, r"^[^_]*_[^_]*_(\d+)", 1).try_cast("int"))


def enrich(results: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Adds graph_category and vertex_scale; sizes(graph_name, vertices) is a small dimension, names of synthetic graphs say theirs."""
    name = F.col("graph_name")
    known = F.when(name.startswith("syn_"), synthetic_vertices(name))
    rows = results
    if sizes is not None:
        rows = rows.join(sizes.select("graph_name", F.col("vertices").alias("__v")), "graph_name", "left")
        known = F.coalesce(F.col("__v").cast("double"), known)
    rows = rows.withColumn("graph_category", category(name)).withColumn("vertex_scale", F.when(known.isNotNull(), vertex_scale(known)))
    return rows.drop("__v")


def normalise(results: DataFrame) -> DataFrame:
    """Adds norm: perf_val over the best of its app and graph."""
    best = results.groupBy("app_name", "graph_name").agg(F.max("perf_val").alias("__best"))
    return results.join(best, ["app_name", "graph_name"]).withColumn("norm", F.when(F.col("__best") > 0, F.col("perf_val") / F.col("__best"))).drop("__best")


def coefficients(rows: DataFrame, sliders: dict[str, float] | None = None) -> Column:
    """The product of the sliders (percent) of category, scale and app; 1.0 * 0.5 without sliders."""
    if not sliders:
        return F.lit(0.5)
    of = lambda c: F.coalesce(*[F.when(F.col(c) == k, F.lit(v / 100.0)) for k, v in sliders.items()], F.lit(0.0))
    return of("graph_category") * of("vertex_scale") * of("app_name")


def rating(results: DataFrame, sliders: dict[str, float] | None = None) -> DataFrame:
    """arch_name, rating, position: weighted sums of normalised results; the best is first, ties by name."""
    rows = normalise(results)
    sums = rows.groupBy("arch_name").agg(F.round(F.sum(coefficients(rows, sliders) * F.col("norm")), 2).alias("rating"))
    # One row for each architecture: a list that is shown.
    return sums.withColumn("position", F.row_number().over(Window.orderBy(F.col("rating").desc(), "arch_name")))


def perf_table(results: DataFrame) -> DataFrame:
    """app_name, graph_name, entries: architectures with their result, best first."""
    entry = F.struct(F.col("perf_val"), F.col("arch_name"))
    return results.groupBy("app_name", "graph_name").agg(F.sort_array(F.collect_list(entry), asc=False).alias("entries"))


def write_results(results: DataFrame, path: str, form: str = "csv") -> None:
    """Sinks for results; nothing is ever unpickled from a network."""
    if form not in ("csv", "parquet", "json"):
        raise ValueError(f"form is csv, parquet or json, not {form}")
    writer = results.write.mode("append")
    (writer.option("header", True).csv if form == "csv" else getattr(writer, form))(path)
