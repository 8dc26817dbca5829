"""The fix-point driver: one Spark job for each iteration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphspark.plans.tables import forget, materialize


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, str, dict]:
    """Materializes df; the metrics come from the same job."""
    if not metrics:
        return *materialize(df, name), {}
    seen = Observation()
    table, path = materialize(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return table, path, seen.get


def fixpoint(step: Callable[[DataFrame, int, dict], DataFrame], state: DataFrame, max_iterations: int = 1 << 30, changed: str | None = "changed", **metrics: Column) -> DataFrame:
    """Applies step(state, iteration, metrics) until no row has `changed`, or max_iterations times.

    Each iteration writes its state to the shared folder, and the count that decides about the next one is observed while it is
    written. metrics are observed too and handed to the next step: a global sum costs no job and no join."""
    spark = state.sparkSession
    if changed is not None:
        metrics = {"n_changed": F.count_if(F.col(changed))} | metrics
    current, path, seen = observed(state, "fixpoint", **metrics)
    for i in range(1, max_iterations + 1):
        if changed is not None and not seen["n_changed"]:
            break
        new, new_path, seen = observed(step(current, i, seen), "fixpoint", **metrics)
        forget(spark, path)
        current, path = new, new_path
    return current.drop(changed) if changed is not None else current


#: Vertices that a task holds at once with its arcs (see blocks).
WHOLE_ROWS = 1 << 22
