"""Mixing of sources to target weights by capped water-filling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.llm.common import WORD_PATTERN, materialize

#: No document is taken more often.
MAX_EPOCHS = 3
#: Documents of one source are dealt by a hash into so many cells, so that no task orders a whole source: at least, at most, and
#: otherwise one for about so many documents of all sources.
CELLS, MOST_CELLS = 1 << 12, 1 << 20
CELL_ROWS = 50_000


def document_size(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, source_col: str) -> DataFrame:
    """Weights 1, 2, 3, repeating, by the code points of the names, null last.

    Names are dealt by ranges and ranked within their range, so no task holds all sources; the ranges' sizes are summed up in order."""
    ranges, _ = materialize(sources.repartitionByRange(F.col(source_col).asc_nulls_last()).withColumn("__range", F.spark_partition_id()), "mix-ranges")
    before = F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.groupBy("__range").count().select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(source_col).asc_nulls_last())) - 1 + F.col("__before")
    return ranges.join(starts, "__range").withColumn("weight", (F.pmod(rank, F.lit(3)) + 1).cast("double")).drop("__range", "__before")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target to sources(source_size long, weight double): shares of the total size by weight, at most max_epochs
    times the source's size; what a clamped source can't take is dealt to the others by weight, until none is above.

    Each round is one aggregate with one row, and a step of Newton's method on a concave function made of straight lines: at least one
    more source is clamped in each, mostly very many. The level only rises, so a clamped source stays clamped.
    """
    cap = (F.col("source_size") * max_epochs).cast("long")
    level = 0.0
    while True:
        clamped = cap <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"), F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)).alias("spent"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("weights"),
        ).first()
        if row["weights"] is None:
            break
        new = (row["budget"] - row["spent"]) / row["weights"]
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights=cyclic_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per row of docs, without its text: all other columns, and size, source_size, target, taken.

    size counts the words (null: 0). A source's documents are all taken target / source_size times, rounded down; the
    rest of its target goes to its documents in the order of a hash of the id with the seed, whole documents but for
    one that is cut, so the words taken are the target rounded to a word. Null is a source of its own.

    The order within a source is found by a running sum over cells of hash values (more for more rows) and one within each cell: no
    task holds a source. The table of sources is aggregated, never collected.
    Edge cases: sources without words have target and taken 0. Rows that repeat are documents of their own; ties in
    the hash go by id, then size. A null id is replaced by the text in the hash. Very long texts are counted where they are read. An empty
    table gives an empty table. Columns named like the results are replaced; others are kept, whatever their names.
    """
    rest = [c for c in docs.columns if c not in (text_col, "size", "source_size", "target", "taken")]
    named = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    hashed = F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long")
    # Of the other columns only those that the mix reads have a name of their own; all travel in one structure, so that no name can clash.
    sized = docs.select(F.struct(*[F.col(c) for c in rest]).alias("rest"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), document_size(text_col).alias("size"), hashed.alias("h"))
    sized, _ = materialize(sized, "mix-sizes")
    cells = min(MOST_CELLS, max(CELLS, 1 << (sized.count() // CELL_ROWS).bit_length()))
    sized = sized.withColumn("cell", F.floor(F.col("h") / ((1 << 32) // cells)).cast("int"))
    by_cell = sized.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    sources, _ = materialize(weights(by_cell.groupBy("source").agg(F.sum("words").alias("source_size")), "source"), "mix-sources")
    sources = water_fill(sources, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).select(F.col("source").alias("s"), "source_size", "target", "whole", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size")).alias("need"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    plan = by_cell.withColumn("before", F.coalesce(before, F.lit(0))).join(sources, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("cell").alias("c"), "before", "source_size", "target", "whole", "need")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    inner = Window.partitionBy("source", "cell").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("need") - F.col("before") - F.coalesce(F.sum("size").over(inner), F.lit(0))
    taken = F.col("size") * F.col("whole") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.withColumn("taken", taken.cast("long")).select(*[F.col("rest").getField(c).alias(c) for c in rest], "size", "source_size", "target", "taken")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
f(step, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, (SELECT (sum(source_size) - coalesce(sum(source_size * 3) FILTER (WHERE source_size * 3 <= f.level * weight), 0))::DOUBLE
                           / sum(weight) FILTER (WHERE source_size * 3 > f.level * weight) FROM w)
  FROM f WHERE step < 40),
l AS (SELECT max(level) AS level FROM f),
t AS (SELECT w.*, CASE WHEN source_size * 3 <= level * weight THEN (source_size * 3)::DOUBLE ELSE level * weight END AS target FROM w, l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT d.doc_id, d.size, n.source_size, n.target, n.whole,
             greatest(0, round(target)::BIGINT - whole * source_size)
             - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, (size * whole + greatest(0, least(size, room)))::BIGINT AS taken FROM r
"""
