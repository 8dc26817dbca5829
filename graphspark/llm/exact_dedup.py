"""Exact deduplication by progressive refinement, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import join_groups

#: Cells of the tables that the first two levels broadcast: their size has this bound whatever the input is.
LENGTH_CELLS = 1 << 16
PREFIX_CELLS = 1 << 20
#: Characters that the second level reads.
PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of docs, without its text: all other columns, and keep_id, group_size, kept.

    Texts are equal when identical, null as empty; of equal texts the row with the largest id stays. Levels: the
    length in bytes; the length with a hash of the first characters; the SHA-256 of the whole text with its length.
    A level passes on the rows whose cell holds several rows. The first two count into tables with a fixed number of
    cells, so what is broadcast is bounded; two groups that meet in one cell only cost work in the next level. The
    full content is hashed for survivors alone; what doesn't survive is a group of one.

    No text is shuffled. A large group is counted by partial aggregates; the largest groups' results are broadcast, a
    fixed number of rows, so that no key of the last join is hot.
    Edge cases: rows that repeat with the same id and text are copies of one document, each counted in group_size and
    marked kept as that document is. A null id never wins over another; groups of null ids only have keep_id null and
    are kept. An empty table gives an empty table. Columns named like the results are replaced.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.octet_length(text)
    prefix = F.xxhash64(length, F.substring(text, 1, prefix_chars))

    def crowded(rows: DataFrame, cell, name: str) -> DataFrame:
        return F.broadcast(rows.groupBy(cell.alias(name)).count().where("count > 1").select(name, F.lit(True).alias(f"{name}_crowded")))

    length_cell = F.pmod(F.xxhash64(length), F.lit(LENGTH_CELLS)).cast("int")
    prefix_cell = F.pmod(prefix, F.lit(PREFIX_CELLS)).cast("int")
    by_length = crowded(docs, length_cell, "__l")
    second = docs.withColumn("__l", length_cell).join(by_length, "__l", "left").withColumn("__p", F.when(F.col("__l_crowded"), prefix_cell))
    by_prefix = crowded(second.where("__p is not null"), F.col("__p"), "__p")
    third = second.join(by_prefix, "__p", "left")
    # A row that is alone has a key of its own kind, spread like any other, and needs no partner in the join.
    alone = F.concat(F.lit("-"), F.hex(prefix))
    third = third.withColumn("__key", F.when(F.col("__p_crowded"), F.concat(F.hex(length), F.lit(":"), F.sha2(text.cast("binary"), 256))).otherwise(alone)).withColumn("__found", F.coalesce("__p_crowded", F.lit(False)))
    narrow = third.drop(text_col, "__l", "__p", "__l_crowded", "__p_crowded")
    groups = narrow.where("__found").groupBy("__key").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1").withColumn("__grouped", F.lit(True))
    spread = F.concat(F.lit("="), F.hex(F.xxhash64(F.col(id_col).cast("string"), F.col("__key"))))
    joined = join_groups(narrow, groups, "__key", "group_size", spread)
    keep = F.when(F.col("__grouped"), F.col("keep_id")).otherwise(F.col(id_col))
    return joined.withColumn("keep_id", keep).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long")).withColumn("kept", F.col("keep_id").eqNullSafe(F.col(id_col))).drop("__key", "__found", "__grouped")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return exact_dedup(docs.withColumn("text_sha256", digest)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
