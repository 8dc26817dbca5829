"""Tables in the folder that all executors share; they end a plan's lineage and outlive a lost executor."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only on one machine a temporary one may take its place."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="graphspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Deletes the shuffle files of an execution as soon as it ends; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files: nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df once and reads it again; returns the table and its path."""
    path = new_path(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Writes df dealt out and sorted by a key, as the joins and groups of a loop need it: they then shuffle the other side alone, which is
    a state or a frontier, and never df. There are as many buckets as shuffle partitions. What the optimizer finds small enough to be broadcast
    to every join isn't dealt out: nothing of it would be shuffled."""
    spark = df.sparkSession
    most = re.fullmatch(r"(-?\d+)b?", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), re.I)
    if int(most[1] if most else 0) > int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())):
        return materialize(df, name)[0]
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"graphspark_{name}_{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
