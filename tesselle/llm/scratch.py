"""Intermediate tables in the folder that all machines share.

A written table cuts the lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import shared_folder

#: Rows that go to a Python worker at once; texts are long, so far below Spark's 10,000.
BATCH_ROWS = 512


def folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a session on one machine may do without, on a cluster a missing one is an error."""
    return shared_folder(spark)


def prepare(spark: SparkSession) -> None:
    """Keep the batches of long texts that Python workers get small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet: ``name``, with as many underscores before it as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = f"{folder(df.sparkSession)}/tesselle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._tesselle_path = path
    return out


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``column`` and read again: joins on it move only their other side."""
    spark, table = df.sparkSession, f"tesselle_{name}_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).sortBy(column).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._tesselle_path, out._tesselle_table = path, table
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`saved` or :func:`bucketed` that no later result reads."""
    if hasattr(df, "_tesselle_table"):
        df.sparkSession.sql(f"drop table if exists {df._tesselle_table}")
    jvm, path = df.sparkSession._jvm, df._tesselle_path
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of results that are written and no longer referred to; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
