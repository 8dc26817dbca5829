"""Comparison of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph


def mismatches(a: DataFrame, b: DataFrame, value: str, tolerance: float = 0.0, relative: bool = False) -> DataFrame:
    """id and both values where they differ by more than the tolerance, or only one is there."""
    both = a.select("id", F.col(value).alias("a")).join(b.select("id", F.col(value).alias("b")), "id", "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    if relative:
        gap = gap / F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-300))
    return both.where(~F.coalesce(F.col("a").eqNullSafe(F.col("b")) | (gap <= tolerance), F.lit(False)))


def equal_values(a: DataFrame, b: DataFrame, value: str, tolerance: float = 0.0) -> bool:
    return mismatches(a, b, value, tolerance).isEmpty()


def equal_rankings(a: DataFrame, b: DataFrame, value: str = "rank", tolerance: float = 1e-9) -> bool:
    """By relative difference: ranks are about 1/V, an absolute one says nothing about many vertices."""
    return mismatches(a, b, value, tolerance, relative=True).isEmpty()


def equal_partitions(a: DataFrame, b: DataFrame, label: str = "component") -> bool:
    """Whether the labels are the same but for their names."""
    both = a.select("id", F.col(label).alias("a")).join(b.select("id", F.col(label).alias("b")), "id", "full_outer")
    if not both.where("a is null or b is null").isEmpty():
        return False
    pairs = both.select("a", "b").distinct()
    return pairs.groupBy("a").count().where("count > 1").isEmpty() and pairs.groupBy("b").count().where("count > 1").isEmpty()


def colour_conflicts(g: Graph, colours: DataFrame) -> DataFrame:
    """Arcs but loops whose ends have one colour."""
    by = lambda end: colours.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))
    return g.edges.where("src <> dst").select("src", "dst").join(by("src"), "src").join(by("dst"), "dst").where("src_colour = dst_colour")
